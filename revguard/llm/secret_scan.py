"""Operator 8: secret scans by character Markov models, with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal strings.  Beside
them every long unbroken string is scored by two first-order character models,
one of random strings and one of ordinary identifiers: the sum over its letter
pairs of ln P(next | letter, random) - ln P(next | letter, identifier).  A
string at or over ``MIN_LLR`` is a secret of kind ``markov`` unless it overlaps
a base span.

The models are trained on a bounded, labelled sample: the documents with the
``SAMPLE_DOCS`` least hashes of doc_id.  What the base rules find there is
random, the words of what is left are identifiers.  To these random strings come
generated ones of the usual makes (``GENERATED``), as the pair counts to expect
of strings whose letters are drawn evenly, so a sample with few secrets, or with
none, still gives a model of randomness.  Letters are folded to lower case, so
the models hold one number per pair of ``ALPHABET`` letters.  Scanning
covers every whole text.  Spans come from the lengths of matches and of what
lies between them, so nothing leaves the JVM.

Defined cases: a null text is empty and has no spans; a sample without secrets
leaves the generated strings, one without words makes that model uniform; rows without doc_id are scanned but
not trained on; repeated rows are scanned each; an empty table gives an empty
result; other columns are ignored (``redacted`` returns them as they are, with
text and, if there, n_chars replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import let, pick

ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_VALUE = 12
# Whole runs are matched, so a least length in the pattern drops the same matches as a later test.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{3,}"
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_-=."
SAMPLE_DOCS = 2000
SMOOTHING = 0.5
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Letters of generated strings, one make each; a letter with two cases is in its make twice.
GENERATED = [DIGITS, DIGITS + "abcdef", DIGITS + LETTERS + LETTERS, DIGITS + LETTERS + LETTERS + "+/", DIGITS + LETTERS + LETTERS + "-_"]
#: Pairs of generated letters of each make.
GENERATED_PAIRS = 5000
MIN_LLR = math.log(1000)
SPANS = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, pattern: str, rank: int, fits: Column | None = None, score=None) -> Column:
    """Code-point spans (start, rank of the kind, end) of a pattern's matches, leftmost first.

    ``fits`` is an array of booleans, one per match; ``score`` maps a match to a boolean.
    """
    def placed(m: Column, between: Column, ok: Column | None) -> Column:
        # each match starts after all text and matches before it
        ends = F.aggregate(
            F.sequence(F.lit(1), F.size(m)),
            F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
            lambda a, i: let(a["at"] + F.length(F.element_at(between, i)), lambda start: F.struct(
                (start + F.length(F.element_at(m, i))).alias("at"),
                F.concat(a["out"], _if_fits(m, ok, score, i, F.array(F.struct(
                    start.alias("start"), F.lit(rank).alias("rank"),
                    (start + F.length(F.element_at(m, i))).alias("end"))))).alias("out"))))
        return ends["out"]

    none = F.array().cast(SPANS)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda b: placed(m, b, None) if fits is None
            else let(fits, lambda ok: placed(m, b, ok)))))


def _if_fits(m: Column, ok: Column | None, score, i: Column, span: Column) -> Column:
    if ok is None and score is None:
        return span
    test = F.element_at(ok, i) if ok is not None else score(F.element_at(m, i))
    return F.when(test, span).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Sorted spans of the base rules of a non-null text."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
                              lambda v: F.length(v) >= ASSIGN_VALUE)
    return F.sort_array(F.concat(_spans(text, ASSIGN, 0, fits=long_enough), _spans(text, ACCESS, 1),
                                 _spans(text, HEX, 2)))


# --- the models ----------------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(string, is_random) from the documents with the least hashes of doc_id."""
    own = pick(docs, "doc_id", "text")
    ids = (own.where("doc_id is not null").select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))  # at most sample_docs ids
    text = own.join(F.broadcast(ids), "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    found = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))
    both = F.concat(F.transform(found, lambda s: F.struct(s.alias("string"), F.lit(True).alias("is_random"))),
                    F.transform(words, lambda s: F.struct(s.alias("string"), F.lit(False).alias("is_random"))))
    return text.select(F.explode(both).alias("s")).select("s.string", "s.is_random")


def generated_pairs() -> dict[str, float]:
    """Expected counts of letter pairs in the generated strings."""
    out: dict[str, float] = {}
    for make in GENERATED:
        for a in make:
            for b in make:
                out[a + b] = out.get(a + b, 0.) + GENERATED_PAIRS / len(make) ** 2
    return out


def train(sample: DataFrame) -> dict[str, float]:
    """Letter pair -> log-likelihood ratio, from labelled strings; at most one entry per pair of the alphabet."""
    folded = F.lower("string")
    pairs = F.when(F.length("string") > 1, F.transform(
        F.sequence(F.lit(1), F.length("string") - 1), lambda i: F.substring(folded, i, F.lit(2))))
    counts = (sample.select("is_random", F.explode(pairs).alias("pair")).groupBy("is_random", "pair").count()
              .where(F.col("pair").rlike(r"^[a-z0-9+/_=.-]{2}$")).collect())
    seen = {(r["is_random"], r["pair"]): r["count"] for r in counts}
    for pair, n in generated_pairs().items():
        seen[True, pair] = seen.get((True, pair), 0) + n
    out = {}
    for a in ALPHABET:
        totals = {k: sum(seen.get((k, a + b), 0) for b in ALPHABET) + SMOOTHING * len(ALPHABET) for k in (True, False)}
        for b in ALPHABET:
            p, q = ((seen.get((k, a + b), 0) + SMOOTHING) / totals[k] for k in (True, False))
            out[a + b] = math.log(p / q)
    return out


def log_ratio(string: Column, model: dict[str, float]) -> Column:
    """Summed log-likelihood ratio of an ASCII string's letter pairs; a constant table indexed by the two codes."""
    table = F.split(F.lit(",".join(repr(model.get(chr(i // 128) + chr(i % 128), 0.0)) for i in range(128 * 128))), ",")
    weights = table.cast("array<double>")
    codes = F.transform(F.split(F.lower(string), ""), lambda c: F.ascii(c))
    return let(codes, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0),
        lambda total, i: total + F.get(weights, F.element_at(c, i) * 128 + F.element_at(c, i + 1))))


def scan(docs: DataFrame, model: dict[str, float], base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with the spans of the base rules and all spans, both sorted by start, then kind."""
    text = F.coalesce(docs["text"], F.lit(""))
    scored = _spans(text, CANDIDATE, 3, score=lambda s: log_ratio(s, model) >= MIN_LLR)

    def merged(b: Column) -> Column:
        return let(scored, lambda m: F.sort_array(F.concat(b, F.filter(m, lambda s: ~F.exists(
            b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))))

    both = let(base_spans(text), lambda b: F.struct(b.alias("base"), merged(b).alias("spans")))
    out = docs.withColumn("__both", both)
    return out.withColumns({base: F.col("__both.base"), spans: F.col("__both.spans")}).drop("__both")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mark``."""
    found = scan(docs, train(labelled_sample(docs)), "__base", "__spans")
    text = F.coalesce(docs["text"], F.lit(""))
    # spans may overlap: only what begins after the last end opens a new mark
    step = F.aggregate(
        F.col("__spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(
                a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out")))
    clean = let(step, lambda r: F.concat(r["out"], F.substring(text, r["at"] + 1, F.length(text))))
    hit = F.size("__spans") > 0
    out = found.withColumn("__clean", F.when(hit, clean).otherwise(docs["text"]))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__clean").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(hit, F.length("__clean").cast(docs.schema[c].dataType))
                           .otherwise(docs[c]).alias(c))
        else:
            columns.append(docs[c])
    return out.select(*columns)
