"""Secret scans: three fixed patterns, and Markov models of random strings against identifiers.

Everything is a column expression: no Python runs on the executors, nothing is shuffled, and a row's work
is linear in its text (times the square root of its matches, for their offsets).

The models are first-order character chains. Labelled samples, random strings and ordinary identifiers, are
tables; their transition counts are aggregated by Spark, smoothed, and the difference of log-likelihoods of
every pair of characters becomes one constant array. A candidate string is flagged when its mean
log-likelihood ratio per transition passes a threshold. Where the whole stays below it, its windows above it
are judged by themselves, so that words glued to secrets don't hide them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A cheap necessary condition, so that most texts never meet the pattern above.
ASSIGN_HINT = r"""(?i:passw|secret|token|api_?key)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Strings the chains judge: long and unbroken. Shorter ones, and numbers, are left to the fixed patterns.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Mean log-likelihood ratio (nats a transition) from which a candidate is random.
THRESHOLD = 0.35
#: Least characters of a window: ends of a random string may score low and fall off.
WINDOW = 14
#: A window ends where the sum over the threshold has fallen this far below its peak (nats).
DROP = 12.0
KINDS = ("assign", "access", "hex", "markov")

_WORDS = (
    "user name account value index count total item list node tree table column row key field type class object method function "
    "handler manager service client server request response message event queue task worker thread process file path folder name "
    "config option setting default update create delete insert select filter search find match replace format parse encode decode "
    "read write open close start stop run load save cache buffer stream reader writer input output source target result error status "
    "code number string array map set get put post page view model control state action test check valid local global public private "
    "static final version release build number image width height color style button window dialog panel layout header footer title "
    "session context provider factory builder adapter wrapper iterator container element document document component interface module "
    "package import export address network socket port host domain http json html query database connection transaction schema record "
    "customer order product price amount invoice payment shipping region nation supplier part line status date time year month day hour"
)


def _prefix_sums(values: Column, block: int = 256) -> Column:
    """Running totals of an array of integers, by blocks, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<bigint>")

    def scan(part: Column, first: Column) -> Column:
        return F.reduce(part, empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), first) + x)))

    n = F.ceil(F.size(values) / F.lit(block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(values, k * block + 1, block))
    # each block with the sum of those before it
    sums = scan(F.transform(cut, lambda p: F.reduce(p, zero, lambda a, x: a + x)), zero)
    firsts = F.concat(F.array(zero), sums)
    return F.flatten(F.zip_with(cut, F.slice(firsts, 1, F.size(cut)), scan))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _spans(text: Column, pattern: str, kind: int, keep, group: int = 0, hint: str | None = None, parts=None) -> Column:
    """Array of (start, rank, end) of the matches that ``keep`` (of the match and its group) lets stay, or of their ``parts``.

    Matches are leftmost and do not overlap; a match that fails still uses up its characters.
    """
    found = _matches(text, pattern)
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(found, lambda m: F.length(m).cast("long"))
    before = F.slice(F.transform(gaps, lambda g: F.length(g).cast("long")), 1, F.size(found))
    ends = _prefix_sums(F.zip_with(before, lengths, lambda g, m: g + m))
    rows = F.arrays_zip(ends.alias("e"), lengths.alias("n"), found.alias("m"), (_matches(text, pattern, group) if group else found).alias("g"))
    spans = F.transform(F.filter(rows, lambda r: keep(r["m"], r["g"])), lambda r: F.struct((r["e"] - r["n"]).alias("start"), F.lit(kind).alias("rank"), r["e"].alias("end")))
    if parts is not None:
        inner = lambda r: F.transform(parts(r["m"]), lambda p: F.struct((r["e"] - r["n"] + p["start"]).alias("start"), F.lit(kind).alias("rank"), (r["e"] - r["n"] + p["end"]).alias("end")))
        spans = F.flatten(F.transform(rows, inner))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    return F.when(text.rlike(hint or pattern), spans).otherwise(none)


def labelled_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(sample, random): digests in four alphabets, and identifiers joined from common words in common styles.

    A table of one's own, say of secrets found before and of names in the code at hand, can take its place.
    """
    words = F.array(*[F.lit(w) for w in dict.fromkeys(_WORDS.split())])
    k = F.size(words)
    at = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), k) + 1).cast("int"))
    ids = spark.range(0, n, 1, 1)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    rand = ids.select(F.explode(F.array(
        F.substring(digest, 1, 40),
        F.substring(F.base64(F.unhex(digest)), 1, 40),
        F.upper(F.substring(F.conv(F.substring(digest, 1, 15), 16, 36), 1, 20)),
        F.translate(F.substring(F.base64(F.unhex(F.sha2(digest, 256))), 1, 32), "+/=", "xYz"),
    )).alias("sample"), F.lit(True).alias("random"))
    digits = F.pmod(F.xxhash64("id", F.lit("d")), F.lit(100)).cast("string")
    plain = ids.select(F.explode(F.array(
        F.concat_ws("_", at("a"), at("b"), at("c")),
        F.concat_ws("-", at("d"), at("e"), at("f"), digits),
        F.concat(at("g"), F.initcap(at("h")), F.initcap(at("i")), digits),
        F.concat_ws("/", at("j"), at("k"), at("l"), at("m")),
        F.upper(F.concat_ws("_", at("n"), at("o"))),
        F.concat(at("p"), at("q"), at("r"), at("s")),
        F.concat(at("t"), F.lit("/"), F.initcap(at("u")), F.initcap(at("v")), F.lit("/__"), at("w"), F.lit("__")),
        F.concat(F.upper(F.substring(at("x"), 1, 4)), F.initcap(at("y")), F.initcap(at("z")), F.lit("/_"), at("aa"), F.lit("_"), at("bb")),
    )).alias("sample"), F.lit(False).alias("random"))
    return rand.unionByName(plain)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every pair of characters, row by row of the alphabet.

    Transitions are counted by Spark; the table that comes back has at most one row for each pair of
    characters of the alphabet. Samples that are null or shorter than two characters count for nothing.
    """
    pairs = samples.where("length(sample) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring("sample", i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    import math

    size, out = len(ALPHABET), []
    for a in ALPHABET:
        row = {r: [counts.get((r, a + b), 0) + smoothing for b in ALPHABET] for r in (True, False)}
        total = {r: sum(row[r]) for r in row}
        out += [math.log(row[True][j] / total[True]) - math.log(row[False][j] / total[False]) for j in range(size)]
    return out


def _steps(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of every transition of one candidate."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    index = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    size = F.size(index)
    return F.zip_with(F.slice(index, 1, size - 1), F.slice(index, 2, size - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))


def _ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per transition of one candidate."""
    return F.reduce(_steps(token, table), F.lit(0.0), lambda acc, x: acc + x) / (F.length(token) - 1)


def _windows(token: Column, table: Column, threshold: float) -> Column:
    """(start, end) of the stretches in which the sum of ratios over ``threshold`` rises to a peak, in characters."""
    zero, none = F.lit(0.0), F.lit(0)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(none.alias("i"), zero.alias("sum"), zero.alias("best"), none.alias("start"), none.alias("end"), empty.alias("done"))

    def long(acc: Column) -> Column:
        return F.when(acc["end"] - acc["start"] >= WINDOW, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x - F.lit(threshold)
        over = (total <= 0) | (total <= acc["best"] - DROP)
        more = total > acc["best"]
        after = acc["i"] + 1
        return F.when(over, F.struct(after.alias("i"), zero.alias("sum"), zero.alias("best"), after.alias("start"), after.alias("end"), long(acc).alias("done"))).otherwise(
            F.struct(after.alias("i"), total.alias("sum"), F.when(more, total).otherwise(acc["best"]).alias("best"), acc["start"].alias("start"), F.when(more, after + 1).otherwise(acc["end"]).alias("end"), acc["done"].alias("done"))
        )

    return F.reduce(_steps(token, table), first, step, long)


def _parts(token: Column, table: Column, threshold: float) -> Column:
    """(start, end) of what is random in a candidate: all of it, or else windows of it."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(token).alias("end")))
    return F.when(_ratio(token, table) >= threshold, whole).otherwise(_windows(token, table, threshold))


def _table(weights: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{w:.5f}" for w in weights)), ",").cast("array<double>")


def all_spans(text: Column, weights: list[float], threshold: float = THRESHOLD) -> list[Column]:
    """Spans of each kind in a text that is not null."""
    table = _table(weights)
    yes = lambda m, g: F.lit(True)
    return [
        _spans(text, ASSIGN, 0, lambda m, g: F.length(g) >= 8, 2, ASSIGN_HINT),
        _spans(text, ACCESS, 1, yes),
        _spans(text, HEX, 2, yes),
        _spans(text, CANDIDATE, 3, yes, parts=lambda m: _parts(m, table, threshold)),
    ]


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for every row; ``samples`` (sample, random) train the chains.

    Offsets are code points, ends exclusive. A null text is empty: no spans, the digest of nothing. Rows are
    independent; repeated rows each get one, null ids are carried, other columns are not read.
    """
    weights = train(samples if samples is not None else labelled_samples(docs.sparkSession))
    base = spread(docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")))
    names = ("a", "b", "c", "m")
    found = base.select("doc_id", *[s.alias(n) for n, s in zip(names, all_spans(F.col("text"), weights, threshold), strict=True)])
    fixed = F.concat("a", "b", "c")
    return found.select(
        "doc_id",
        *[F.size(n).cast("long").alias(f"n_{k}") for n, k in zip(names, KINDS, strict=True)],
        F.sha2(_listed(fixed), 256).alias("base_sha256"),
        _listed(F.concat(fixed, "m")).alias("spans"),
    )


def _cut(token: Column, parts: Column, mask: str) -> Column:
    """The candidate with its parts, in order and apart, replaced by ``mask``."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, p: F.struct(p["end"].alias("at"), F.concat(acc["out"], F.substring(token, acc["at"] + 1, p["start"] - acc["at"]), F.lit(mask)).alias("out"))
    return F.reduce(parts, first, step, lambda acc: F.concat(acc["out"], F.substring(token, acc["at"] + 1, F.length(token))))


def _masked(text: Column, pattern: str, keep, mask: str, group: int = 0, hint: str | None = None, parts=None) -> Column:
    """The text with every match that ``keep`` holds for, or its ``parts``, replaced by ``mask``; linear in the text."""
    found, gaps = _matches(text, pattern), F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), (_matches(text, pattern, group) if group else found).alias("g"))
    filled = F.transform(rows, lambda r: F.when(keep(r["m"], r["g"]), F.lit(mask)).otherwise(r["m"]))
    if parts is not None:
        filled = F.transform(rows, lambda r: _cut(r["m"], parts(r["m"]), mask))
    joined = F.array_join(F.zip_with(gaps, filled, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(hint or pattern), joined).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]", threshold: float = THRESHOLD, samples: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret of its text masked, kind after kind, and the length column brought up to date.

    A null text stays null. Rows and all other columns stay as they are.
    """
    table = _table(train(samples if samples is not None else labelled_samples(docs.sparkSession)))
    yes = lambda m, g: F.lit(True)
    steps = (
        (ASSIGN, lambda m, g: F.length(g) >= 8, 2, ASSIGN_HINT),
        (ACCESS, yes, 0, None),
        (HEX, yes, 0, None),
        (CANDIDATE, yes, 0, None, lambda m: _parts(m, table, threshold)),
    )
    # one column a step: nested, each would be evaluated many times over
    out = reduce(lambda df, s: df.withColumn(text_col, _masked(F.col(text_col), s[0], s[1], mask, *s[2:])), steps, spread(docs))
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out.select(*docs.columns)
