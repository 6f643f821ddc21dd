"""Secret scan over a trigram inverted index. Native: DataFrame functions only.

Each rule's regex yields a Boolean query over the trigrams a match must hold.
Postings of those trigrams are intersected and united into candidate
documents, and only candidates are searched with the regex. A rule whose
regex requires no trigram is searched in every document.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import UPPER, ascii_lower, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` (Java syntax), case folding of A-Z, and the least length of ``group``."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0


#: The base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    Rule("hex", r"[0-9a-f]+", False, 0, 32),
)
#: Further public credential formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

# ---- trigram queries -------------------------------------------------------
# A query is None (no trigram is required), or a frozenset of alternatives,
# each a frozenset of trigrams of which all are required.

_MOST = 16  # strings followed exactly through a regex


def _cross(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    out = {x + y for x in a for y in b} if a is not None and b is not None else None
    return out if out is not None and len(out) <= _MOST else None


def _strings(node: tuple) -> set[str] | None:
    """All strings a node can match, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN:
        if all(o is C.LITERAL for o, _ in arg) and len(arg) <= _MOST:
            return {chr(v) for _, v in arg}
        return None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is C.BRANCH:
        each = [_sequence_strings(x) for x in arg[1]]
        out = set().union(*each) if all(x is not None for x in each) else None
        return out if out is not None and len(out) <= _MOST else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 3:
        one, out = _sequence_strings(arg[2]), set()
        for n in range(arg[0], arg[1] + 1):
            made = reduce(_cross, [one] * n, {""})
            if made is None:
                return None
            out |= made
        return out if len(out) <= _MOST else None
    return None


def _sequence_strings(nodes) -> set[str] | None:
    return reduce(_cross, map(_strings, nodes), {""})


def _of_strings(strings: set[str]) -> frozenset | None:
    """Alternatives: all trigrams of one of the strings."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b)


def _query(nodes) -> frozenset | None:
    out: frozenset | None = None
    known: set[str] = {""}
    for node in nodes:
        more = _cross(known, _strings(node))
        if more is not None:
            known = more
            continue
        out, known = _both(out, _of_strings(known)), _strings(node) or {""}
        op, arg = node
        if op is C.SUBPATTERN:
            out = _both(out, _query(arg[3]))
        elif op is C.BRANCH:
            each = [_query(x) for x in arg[1]]
            out = _both(out, frozenset().union(*each) if all(x is not None for x in each) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            out = _both(out, _query(arg[2]))
    return _both(out, _of_strings(known))


def trigram_query(rule: Rule) -> frozenset | None:
    """Alternatives of lower-case (A-Z) trigrams, one of which every matching text holds in full; None if none is required."""
    found = _query(P.parse(rule.pattern))
    lower = str.maketrans(UPPER, UPPER.lower())
    return None if found is None else frozenset(frozenset(t.translate(lower) for t in one) for one in found)


# ---- index -----------------------------------------------------------------

KEPT = 2  # trigrams of an alternative that are indexed: each costs a search of every text, and few more documents pass


def indexed_query(queries: dict[str, frozenset]) -> dict[str, frozenset]:
    """Weaker queries that any text with a match still satisfies: of an alternative's trigrams KEPT at most, those of most alternatives first."""
    uses = Counter(t for q in queries.values() for one in q for t in one)
    kept = lambda one: frozenset(sorted(one, key=lambda t: (-uses[t], t))[:KEPT])
    return {kind: frozenset(map(kept, q)) for kind, q in queries.items()}


def trigram_postings(keyed: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The index: (``_gram``: position in ``trigrams``, ``key``) for every lower-cased text that holds the trigram."""
    low = ascii_lower(F.col(text))
    grams = F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return keyed.select(key, low.alias("_low")).select(F.explode(F.array_compact(grams)).alias("_gram"), key)


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, frozenset], key: str) -> DataFrame:
    """(``key``, ``_rules``): the rules whose Boolean query the postings satisfy; a key needs one at least."""
    at = {t: i for i, t in enumerate(trigrams)}
    words = -(-max(len(trigrams), 1) // 62)
    bits = [
        F.bit_or(F.when(F.floor(F.col("_gram") / 62) == w, F.expr(f"shiftleft(1L, int(_gram - {62 * w}))")).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}")
        for w in range(words)
    ]
    held = postings.groupBy(key).agg(*bits)

    def holds(one: frozenset) -> Column:
        need = [sum(1 << (at[t] - 62 * w) for t in one if at[t] // 62 == w) for w in range(words)]
        tests = [F.col(f"_w{w}").bitwiseAND(F.lit(n).cast("long")) == n for w, n in enumerate(need) if n]
        return reduce(Column.__and__, tests)

    rules = F.array_compact(F.array(*[F.when(reduce(Column.__or__, map(holds, q)), F.lit(k)) for k, q in queries.items()]))
    return held.select(key, rules.alias("_rules")).where(F.size("_rules") > 0)


# ---- verification ----------------------------------------------------------


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches in code points; leftmost, non-overlapping, then those long enough."""
    pattern = F.lit(("(?i)" if rule.ignore_case else "") + rule.pattern)
    between = F.split(text, ("(?i)" if rule.ignore_case else "") + rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.arrays_zip(
        F.slice(F.transform(between, F.char_length), 1, F.greatest(F.size(whole), F.lit(0))).alias("gap"),
        F.transform(whole, F.char_length).alias("len"),
        F.transform(measured, F.char_length).alias("own"),
    )
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + p["len"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"] >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def _scan(text: Column, rule: Rule, wanted: Column) -> Column:
    """A rule's spans as array<struct<start, kind number, kind, end>>, searched where ``wanted``."""
    # One class, repeated: its matches are maximal runs, so a least length may stand in the pattern.
    quick = rule.pattern
    if rule.group == 0 and rule.least and re_single_run(rule.pattern):
        quick = rule.pattern[:-1] + f"{{{rule.least},}}"
    searched = Rule(rule.kind, quick, rule.ignore_case, rule.group, rule.least)
    number = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    hit = wanted & text.rlike(("(?i)" if rule.ignore_case else "") + quick)
    named = F.transform(
        _spans(text, searched), lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("no"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"))
    )
    return F.when(hit, named)


def re_single_run(pattern: str) -> bool:
    nodes = list(P.parse(pattern))
    return len(nodes) == 1 and nodes[0][0] is C.MAX_REPEAT and nodes[0][1][0] == 1 and [n[0] for n in nodes[0][1][2]] == [C.IN] and pattern.endswith("]+")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``id_col, _spans`` -- for every row its array<struct<start, no, kind, end>>, sorted by start, then kind as listed.

    Postings, candidates and hits are keyed by the digest of the text, so ids
    may be null or repeated and a shared text has one posting list entry.
    Null text counts as empty. Null or repeated ids are returned as they come;
    an empty table gives an empty result; other columns are not read.
    """
    queries = indexed_query({r.kind: q for r in rules if (q := trigram_query(r)) is not None})
    trigrams = sorted(set().union(*[t for q in queries.values() for t in q])) if queries else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    key = F.unhex(F.md5("_text"))
    everywhere = [r for r in rules if r.kind not in queries]
    none = F.array().cast("array<struct<start:int,no:int,kind:string,end:int>>")
    base = keyed.select("_id", key.alias("_key"), F.concat(none, *[F.coalesce(_scan(F.col("_text"), r, F.lit(True)), none) for r in everywhere]).alias("_full"))
    if queries:
        keyed = keyed.withColumn("_key", key)
        postings = trigram_postings(keyed, trigrams, "_key", "_text")
        chosen = stored(candidates(postings, trigrams, queries, "_key"), "secret-candidates")
        texts = keyed.join(chosen, "_key")
        found = F.concat(none, *[F.coalesce(_scan(F.col("_text"), r, F.array_contains("_rules", r.kind)), none) for r in rules if r.kind in queries])
        hits = texts.select("_key", found.alias("_found")).where(F.size("_found") > 0)
        hits = stored(hits.groupBy("_key").agg(F.first("_found").alias("_found")), "secret-hits")
        base = base.join(hits, "_key", "left").withColumn("_full", F.concat("_full", F.coalesce("_found", none)))
    return base.select(F.col("_id").alias(id_col), F.array_sort("_full").alias("_spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans`` of :func:`scan_secrets`, one row per row of ``docs``."""
    spans = F.col("_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["no"] < len(BASE_RULES))
    return scan_secrets(docs, id_col, text_col).select(
        id_col,
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``spans`` (from :func:`scan_secrets`) replaced by ``mark``; overlapping spans as one. Native.

    Other columns, of any name, are unchanged. Ids must tell rows apart: of
    several rows' spans under one id the smallest are used for all rows of that id. Rows
    with a null id, without spans, or with a null text come back as they are.
    """
    body = F.col("row").getField(text_col)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    kept = F.aggregate(
        "found",
        first,
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))),
    )
    found = spans.where(F.size("_spans") > 0).groupBy(F.col(id_col).alias("key")).agg(F.min("_spans").alias("found"))
    joined = docs.select(F.struct("*").alias("row")).join(found, F.col("row").getField(id_col) == F.col("key"), "left")
    text = F.when(F.col("found").isNotNull(), kept).otherwise(body)
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
