"""Texts that stop before their end: a classifier trained on texts cut on purpose.

Positives are made by cutting given texts: at the length limits of their source, at places spread over the
text, and right behind points that end nothing (abbreviations, decimals, claim numbers), with and without the
marks that a broken transfer leaves. Negatives are the given texts; after a first fit those that look cut are
left out and the model is fitted again. Features are hashed strings about the closing characters, the
punctuation, the last item and its heading, and whether the length is at a limit of the source. The model is
fitted on a bounded sample of texts (``train_texts``); limits are counted over all texts and every text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.functions.columns import computed_once

TRAIN_TEXTS = 12_000
#: Weights in the fit: given texts, cuts, and cuts behind points that end nothing.
WEIGHTS = {"given": 1.0, "cut": 1.0, "trap": 0.2}
_FEATURES = 1 << 15
_BLANKS = " \t\r\n　"
#: What a cut or its clean-up leaves behind, as it stands at the end of a text.
_MARKS = r"(?:\.{3,}|…+|\[(?:…|\.{3})\]|\((?:…|\.{3})\)|�+|&[A-Za-z#0-9]{0,6}|<[A-Za-z/]{0,8})$"
_ADDED = ("", "", "", "", "", "...", "…", " […]", " ...", "   \n", "-", " ", "�", " &am", " <su")


#: Points that look like an end and are none: claim numbers, decimals, abbreviations.
_TRAPS = r"(?s)^(.*?(?:\n[0-9]+\.|[0-9]\.(?=[0-9])|\b(?:FIG|Fig|fig|FIGS|Figs|e\.g|i\.e|z\.B|p\.ej|No|Nr)\.))"


@dataclass(frozen=True)
class TruncationModel:
    """A fitted model, none where there was no text to learn from; ``limits`` are the lengths (by source and measure) at which texts are cut."""

    model: LogisticRegressionModel | None
    limits: DataFrame


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _measures(text: Column) -> dict[str, Column]:
    return {"chars": F.length(text), "bytes": F.octet_length(text), "words": F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1}


def length_limits(df: DataFrame, source: str, text: str, least: int = 5, least_share: float = 0.01) -> DataFrame:
    """(_source, _measure, _limit): lengths in characters, bytes or words (parts between blanks) at which a source cuts.

    A limit is a length of ``least`` texts and ``least_share`` of a source's texts, and of three times as many as
    any length next to it. Counted over all texts.
    """
    sizes = F.array(*(F.struct(F.lit(name).alias("_measure"), size.alias("_limit")) for name, size in _measures(F.col(text)).items()))
    counts = df.where(F.length(text) > 0).select(F.col(source).alias("_source"), F.inline(sizes)).groupBy("_source", "_measure", "_limit").agg(F.count(F.lit(1)).alias("_n"))
    of_source = Window.partitionBy("_source", "_measure")
    by_length = of_source.orderBy("_limit")
    beside = F.greatest(*(F.coalesce(F.max("_n").over(by_length.rangeBetween(*near)), F.lit(0)) for near in ((-2, -1), (1, 2))))
    stands_out = (F.col("_n") >= least) & (F.col("_n") >= F.col("_all") * least_share) & (F.col("_n") >= 3 * F.col("_beside"))
    return counts.withColumn("_all", F.sum("_n").over(of_source)).withColumn("_beside", beside).where(stands_out & (F.col("_limit") >= F.when(F.col("_measure") == "words", 20).otherwise(100))).select("_source", "_measure", "_limit")


def _shape(text: Column) -> Column:
    """Runs of characters of a kind as one letter: digits 9, lower a, upper A, kana K, ideographs H."""
    for pattern, letter in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\d+", "9"), (r"[\p{IsHiragana}\p{IsKatakana}ー]+", "K"), (r"\p{IsHan}+", "H")):
        text = F.regexp_replace(text, pattern, letter)
    return text


def _tagged(tag: str, *values: Column) -> Column:
    return F.concat_ws("|", F.lit(tag), *(v.cast("string") for v in values))


def with_features(df: DataFrame, text: str, at_limit: Column) -> DataFrame:
    """Adds ``_features``, an array of strings about the end of ``text``."""
    trimmed = df.withColumn("_at_limit", at_limit).withColumn("_t", F.rtrim(F.col(text), F.lit(_BLANKS)))
    marked = trimmed.withColumn("_mark", F.regexp_extract(F.right("_t", F.lit(12)), _MARKS, 0))
    body = marked.withColumn("_b", F.rtrim(F.left("_t", F.length("_t") - F.length("_mark")), F.lit(_BLANKS)))
    lines = (
        body.withColumn("_line", F.substring_index("_b", "\n", -1))
        .withColumn("_above", F.when(F.instr("_b", "\n") > 0, F.substring_index(F.substring_index("_b", "\n", -2), "\n", 1)).otherwise(F.lit("")))
        .withColumn("_tail", F.regexp_replace(F.right("_b", F.lit(32)), r"[0-9]", "9"))
        .withColumn("_end", _shape(F.right("_line", F.lit(32))))
        .withColumn("_head", F.left(_shape(F.left("_line", F.lit(16))), F.lit(4)))
        .withColumn("_last", F.right("_end", F.lit(1)))
        .withColumn("_list", F.col("_line").rlike(r"^[0-9]+ [^.。;；]*$") & (F.length("_above") <= 40))
    )
    mark = F.when(F.col("_mark") == "", F.lit("none")).otherwise(F.left("_mark", F.lit(1)))
    word = F.regexp_extract("_tail", r"(\S+)$", 1)
    two = F.regexp_extract("_tail", r"(\S+\s+\S+)$", 1)
    item = F.regexp_extract("_line", r"[0-9] ([^0-9]+)$", 1)
    opened = F.signum(_count(F.col("_line"), "([（［「『„“<") - _count(F.col("_line"), ")]）］」』”“>"))
    short = F.length("_line") <= 30
    features = [
        _tagged("bias"),
        *(_tagged(f"e{n}", F.right("_tail", F.lit(n))) for n in (1, 2, 3, 4, 6)),
        _tagged("word", word),
        _tagged("two", two),
        *(_tagged(f"s{n}", F.right("_end", F.lit(n))) for n in (1, 2, 3, 5)),
        _tagged("head", F.col("_head"), F.col("_last")),
        _tagged("mark", mark),
        _tagged("open", opened, F.col("_last")),
        _tagged("limit", F.col("_at_limit")),
        _tagged("limit_last", F.col("_at_limit"), F.col("_last")),
        _tagged("long", F.floor(F.log2(F.length("_line") + 1)), F.col("_last")),
        _tagged("size", F.floor(F.log2(F.length("_b") + 1))),
        F.when(short, _tagged("line", F.regexp_replace("_line", r"[0-9]+", "9"))),
        F.when(F.length("_above") <= 40, _tagged("above", F.regexp_replace("_above", r"[0-9]+", "9"), F.col("_last"))),
        F.when(F.col("_list"), _tagged("list", F.col("_last"))),
        F.when(F.col("_list"), _tagged("item", item)),
        F.when(F.col("_list"), _tagged("listed", F.regexp_replace("_above", r"[0-9]+", "9"))),
    ]
    return lines.withColumn("_features", F.array_compact(F.array(*features))).drop("_t", "_mark", "_b", "_line", "_above", "_tail", "_end", "_head", "_last", "_list")


_MEASURES = ("chars", "bytes", "words")


def _with_limits(df: DataFrame, source: str, limits: DataFrame) -> DataFrame:
    """Adds ``_limits_<measure>``, the limits of the row's source (at most 1 / least_share each)."""
    known = limits.groupBy("_source").agg(*(F.collect_set(F.when(F.col("_measure") == m, F.col("_limit"))).alias(f"_limits_{m}") for m in _MEASURES))
    return df.join(known, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")


def _at_limit(text: Column) -> Column:
    """The measure in which ``text`` is as long as a limit of its source, else 'no'."""
    at = [F.when(F.array_contains(f"_limits_{name}", size), F.lit(name)) for name, size in _measures(text).items()]
    return F.coalesce(*at, F.lit("no"))


def _cuts(texts: DataFrame, record: str, text: str, seed: int) -> DataFrame:
    """Cut versions of texts, label 1."""
    u = [F.pmod(F.xxhash64(record, F.lit(seed + i)), F.lit(1 << 30)) / F.lit(float(1 << 30)) for i in range(3)]
    n = F.length(F.rtrim(F.col(text), F.lit(_BLANKS)))
    anywhere = [F.left(text, F.greatest(F.lit(1), F.floor(n * x).cast("int"))) for x in u[:2]]
    within = F.floor(F.length(text) * u[2] * 0.8).cast("int")
    trap = F.regexp_extract(F.substring(text, within + 1, F.length(text)), _TRAPS, 1)
    size = _measures(F.col(text))
    least = {m: F.array_min(f"_limits_{m}") for m in _MEASURES}
    at = F.coalesce(*(F.when(size[m] > least[m], F.lit(m)) for m in ("words", "chars", "bytes")))
    to_limit = (
        F.when(at == "words", F.call_function("substring_index", F.col(text), F.lit(" "), least["words"]))
        .when(at == "bytes", F.regexp_replace(F.make_valid_utf8(F.substring(F.col(text).cast("binary"), F.lit(1), least["bytes"]).cast("string")), "\ufffd+$", ""))
        .otherwise(F.left(text, least["chars"]))
    )
    cut = lambda c, kind: F.struct(c.alias("text"), F.lit(kind).alias("kind"))
    made = F.array(*(cut(c, "anywhere") for c in anywhere), F.when(trap != "", cut(F.left(text, within + F.length(trap)), "trap")), F.when(at.isNotNull(), cut(to_limit, "limit")))
    rows = texts.select(record, *(f"_limits_{m}" for m in _MEASURES), "_fold", F.col(text).alias("_whole"), F.explode(F.array_compact(made)).alias("_cut"))
    # a cut between two sentences or lines leaves a complete text: no positive
    shown = F.rtrim(F.col("_cut.text"), F.lit(_BLANKS))
    following = F.substring(F.col("_whole"), F.length("_cut.text") + 1, F.lit(1))
    between = (F.col("_cut.kind") != "trap") & (F.right(shown, F.lit(1)).isin(list(".。)）]!?>-*_")) | (following == "\n"))
    which = F.pmod(F.xxhash64(record, F.col("_cut.text"), F.lit(seed)), F.lit(len(_ADDED))).cast("int")
    mark = F.get(F.array(*(F.lit(m) for m in _ADDED)), which)
    return rows.where(~between & (F.length(shown) > 0)).select(F.concat(F.col("_cut.text"), mark).alias(text), "_fold", _at_limit(F.col("_cut.text")).alias("_at"), F.lit(1.0).alias("label"), F.when(F.col("_cut.kind") == "trap", F.lit(WEIGHTS["trap"])).otherwise(F.lit(WEIGHTS["cut"])).alias("_weight"))


def fit(df: DataFrame, record: str, source: str, text: str, train_texts: int = TRAIN_TEXTS, seed: int = 11) -> TruncationModel:
    """Fits the model on about ``train_texts`` texts, chosen by the hash of ``record``, and their cut versions."""
    limits = length_limits(df, source, text).persist()
    rows = df.where(F.length(F.trim(F.col(text), F.lit(_BLANKS))) > 0)
    n = rows.count()
    if n == 0:
        return TruncationModel(None, limits)
    keep = F.pmod(F.xxhash64(record, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, train_texts / n) * (1 << 30)))
    fold = F.pmod(F.xxhash64(F.right(F.rtrim(F.col(text), F.lit(_BLANKS)), F.lit(24)), F.lit(seed)), F.lit(2))  # equal endings together
    texts = _with_limits(rows.where(keep).select(record, source, text, fold.alias("_fold")), source, limits).persist()
    hashing = HashingTF(numFeatures=_FEATURES, binary=True, inputCol="_features", outputCol="features")
    given = texts.select(text, "_fold", _at_limit(F.col(text)).alias("_at"), F.lit(0.0).alias("label"), F.lit(WEIGHTS["given"]).alias("_weight"))
    made = given.unionByName(_cuts(texts, record, text, seed)).withColumn("_doubtful", (F.col("label") == 0) & (F.col("_at") != "no"))
    data = hashing.transform(with_features(made, text, F.col("_at"))).select("features", "label", "_fold", "_doubtful", "_weight")
    data = data.coalesce(df.sparkSession.sparkContext.defaultParallelism).persist()  # few rows, read in every step of the fit: a partition for each core
    regression = LogisticRegression(regParam=3e-3, maxIter=25, weightCol="_weight")
    screen = regression.copy({regression.maxIter: 12})
    # a text that looks cut to a model that has not seen it is no example of an intact one
    given_by_fold = {r["_fold"] for r in data.where("label = 0 and not _doubtful").select("_fold").distinct().collect()}
    clean = None if given_by_fold == {0, 1} else data.select("features", "label", "_weight")
    for k in (0, 1) if clean is None else ():
        other = screen.fit(data.where((F.col("_fold") != k) & ~F.col("_doubtful")))
        kept = other.transform(data.where(F.col("_fold") == k)).where((F.col("label") == 1) | (vector_to_array("probability")[1] < 0.5)).select("features", "label", "_weight")
        clean = kept if clean is None else clean.unionByName(kept)
    model = regression.fit(clean)
    data.unpersist()
    texts.unpersist()
    return TruncationModel(model, limits)


def score(df: DataFrame, fitted: TruncationModel, record: str, source: str, text: str) -> DataFrame:
    """Rows (record, source, truncated, probability) for every row of ``df``.

    Null texts and texts without a visible character are complete: there is nothing in them that stops.
    """
    if fitted.model is None:
        return df.select(record, source, F.lit(False).alias("truncated"), F.lit(0.0).alias("probability"))
    rows = _with_limits(df.select(F.col(record), F.col(source), F.coalesce(F.col(text), F.lit("")).alias(text)), source, fitted.limits)
    hashing = HashingTF(numFeatures=_FEATURES, binary=True, inputCol="_features", outputCol="features")
    featured = hashing.transform(with_features(rows, text, _at_limit(F.col(text))).withColumn("_empty", F.length(F.trim(F.col(text), F.lit(_BLANKS))) == 0))
    probability = F.when(F.col("_empty"), F.lit(0.0)).otherwise(vector_to_array("probability")[1])
    scored = fitted.model.transform(featured.select(record, source, "_empty", "features"))
    return computed_once(scored.select(record, source, "_empty", "probability"), _p=probability).select(record, source, (F.col("_p") > 0.5).alias("truncated"), F.col("_p").alias("probability"))
