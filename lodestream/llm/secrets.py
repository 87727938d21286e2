"""Secret scan: three fixed patterns, and character Markov models for what they miss.

Everything is DataFrame functions. Two first-order Markov chains over characters, one of random
strings and one of ordinary identifiers, are trained from samples that the fixed patterns label:
the values they find are the random strings, long words outside their matches the identifiers.
A run of identifier characters outside every fixed match is a secret if its mean log-likelihood
ratio a transition passes a threshold, whatever characters it has. Matches and their places come from cutting a text by the
pattern and adding up the lengths of what lies between and of the matches, so there is no
shuffle on the main path; the trained chains are one literal of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: The fixed patterns (kind, pattern, group that must be long enough, characters it must have).
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
#: The same matches without the work of finding those that are too short (a run shorter than the
#: least is no match wherever in it one begins, so that dropping it first changes nothing).
_FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}

#: Characters of identifiers, in the order of their codes 1 to 66; code 0 is any other.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
STATES = len(ALPHABET) + 1
#: Candidates: whole runs of at least this many characters of identifiers, which ``/`` and ``=`` end.
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+_])[A-Za-z0-9+_]{{{LEAST},}}"
#: Ordinary identifiers to learn from: whole runs of letters and underscores.
ORDINARY = r"(?<![A-Za-z0-9+/_=])[A-Za-z_]{12,}(?![A-Za-z0-9+/_=])"
#: Labelled samples that every model starts from, each counted SAMPLE_WEIGHT times.
SAMPLES = """
configuration_value current_user_name request_handler response_status default_timeout connection_string
maximumRetryCount isAuthenticated getDisplayName applicationContext databaseConnection serializeToString
internationalization responsibilities characteristics understanding representation communication
Verantwortung Geschwindigkeit Zusammenarbeit Wissenschaft responsabilidad comunicacion desarrollo
developpement gouvernement environnement connaissance https/www/example/index/articles/archive
parseXMLDocument toJSONString HTTPClientFactory loadURLFromCache IOExceptionHandler getUUIDForSession
DEFAULT_BUFFER_SIZE MAX_RETRY_ATTEMPTS INVALID_ARGUMENT HTTP_STATUS_NOT_FOUND ENVIRONMENT_VARIABLE LOG_LEVEL
image_2x version_1 page_10 section_3_1 utf8_general iso8859 mp3player html5 v2beta abcdefghijklmnopqrstuvwxyz
""".split()
SAMPLE_WEIGHT = 4
#: Numbers are ordinary: every pair of digits is counted this often.
DIGIT_WEIGHT = 30
#: Least mean log-likelihood ratio a transition (nats).
THRESHOLD = 2.0

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """For each match: length of the gap before it, of the match and of the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(value, F.length).alias("size"))


def _spans(matches: Column, rank: int, kind: str, least: int) -> Column:
    """Spans of the matches whose group is long enough."""
    empty = F.expr(f"CAST(array() AS array<{_SPAN}>)")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + m["own"]).alias("end"), F.lit(kind).alias("kind")))
        return F.struct((start + m["own"]).alias("at"), F.when(m["size"] >= least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, __t, __base): all columns packed, the text (null as empty), the fixed patterns' spans by start and kind."""
    out = packed(docs, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__t"))
    for kind, pattern, group, _ in PATTERNS:
        pattern = _FAST.get(kind, pattern)
        out = out.withColumn(f"__{kind}", F.when(F.col("__t").rlike(pattern), _matches(F.col("__t"), pattern, group)))
    parts = [F.coalesce(_spans(F.col(f"__{kind}"), k, kind, least), F.expr(f"CAST(array() AS array<{_SPAN}>)")) for k, (kind, _, _, least) in enumerate(PATTERNS)]
    out = out.withColumn("__base", F.array_sort(F.concat(*parts)))
    return out.drop(*[f"__{kind}" for kind, *_ in PATTERNS])


def _codes(token: Column) -> Column:
    table = [0] * 128
    for k, ch in enumerate(ALPHABET):
        table[ord(ch)] = k + 1
    classes = F.array(*[F.lit(x) for x in table])
    return F.transform(F.split(token, ""), lambda ch: F.coalesce(F.get(classes, F.ascii(ch)), F.lit(0)))


def _transitions(token: Column) -> Column:
    codes = _codes(token)
    n = F.size(codes)
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a * STATES + b)


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = 20_000) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all STATES^2 transitions, from about
    ``sample_docs`` documents chosen by a hash of the text, which bounds the labelled sample.

    Counts start from a prior: random strings are uniform over the alphabet (weight 20 a state),
    identifiers as frequent as their letters, and both start from SAMPLES."""
    n = docs.count()
    few = docs.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    if n > sample_docs:
        few = few.where(F.pmod(F.xxhash64("t", F.lit("secrets")), F.lit(1_000_003)) < 1_000_003 * sample_docs / n)
    based = base_spans(few, "t")
    secrets = based.where(F.size("__base") > 0).select(F.lit(1).alias("y"), F.explode(F.transform("__base", lambda s: F.regexp_extract(F.substring(F.col("__t"), s["start"] + 1, s["end"] - s["start"]), r"[A-Za-z0-9+/_=]+$", 0))).alias("w"))
    words = few.select(F.lit(0).alias("y"), F.explode(F.regexp_extract_all(F.col("t"), F.lit(ORDINARY), F.lit(0))).alias("w"))
    pairs = secrets.unionByName(words).select("y", F.explode(_transitions(F.col("w"))).alias("k"))
    counts = [[0.0] * STATES**2 for _ in range(2)]
    for row in pairs.groupBy("y", "k").agg(F.count("*").alias("n")).collect():  # at most 2 STATES^2 rows
        counts[row["y"]][row["k"]] = float(row["n"])
    for word in SAMPLES:
        codes = [ALPHABET.find(c) + 1 for c in word]
        for a, b in zip(codes, codes[1:], strict=False):
            counts[0][a * STATES + b] += SAMPLE_WEIGHT
    total = sum(counts[0])
    column = [sum(counts[0][a * STATES + b] for a in range(STATES)) for b in range(STATES)]
    often = [(c + 1) / (total + STATES) for c in column]
    # Numbers say how digits follow each other, not how often a digit follows something else.
    digits = [ALPHABET.index(c) + 1 for c in "0123456789"]
    for a in digits:
        for b in digits:
            counts[0][a * STATES + b] += DIGIT_WEIGHT
    out = []
    for a in range(STATES):
        rows = [counts[y][a * STATES : (a + 1) * STATES] for y in range(2)]
        sums = [sum(r) for r in rows]
        for b in range(STATES):
            ordinary = (rows[0][b] + 5 * often[b]) / (sums[0] + 5)
            random = (rows[1][b] + 20 / STATES) / (sums[1] + 20)
            out.append(round(math.log(random / ordinary), 4))
    return out


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of (start, rank, end, kind) in code points,
    end exclusive, sorted by start and kind; ``__spans`` also has those of the Markov models, of
    kind ``random``, which never touch one of the fixed patterns.

    Null and empty text has no spans; texts are scanned whole; rows that repeat give equal spans;
    an empty table gives an empty one; every row and column stays, but for one with a result's name."""
    model = F.array(*[F.lit(x) for x in ratios])
    out = base_spans(docs, text_col)
    found = F.regexp_extract_all(F.col("__t"), F.lit(CANDIDATE), F.lit(0))
    likely = F.transform(found, lambda w: F.aggregate(_transitions(w), F.lit(0.0), lambda a, k: a + F.get(model, k)) / (F.length(w) - 1))
    good = F.transform(likely, lambda x: F.when(x >= threshold, 1).otherwise(0))  # what _spans takes for a size
    gaps = F.slice(F.split(F.col("__t"), CANDIDATE, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("own"), good.alias("size"))
    out = out.withColumn("__random", F.when(F.col("__t").rlike(CANDIDATE), zipped))
    spans = F.coalesce(_spans(F.col("__random"), len(PATTERNS), "random", 1), F.expr(f"CAST(array() AS array<{_SPAN}>)"))
    out = out.withColumn("__random", spans)
    apart = F.filter("__random", lambda r: ~F.exists("__base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return unpacked(out, docs.columns, __base=F.col("__base"), __spans=F.array_sort(F.concat("__base", apart)))
