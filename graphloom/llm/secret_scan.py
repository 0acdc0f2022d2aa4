"""Secret scans by a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived, case folded. One scan gives the postings
(trigram, document) of the trigrams that any rule asks for, of the documents that some clause's rarest trigram leads to;
a clause's candidates are the documents in all of its postings. Candidates are then verified by the expression itself. Rules of which no trigram is mandatory have every
document as candidate.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

WIDEST, MOST = 4, 64


class Rule(NamedTuple):
    """Matches of ``pattern`` whose group ``group`` has ``least`` code points at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _strings(node: list) -> set[str] | None:
    """All strings a parsed sequence can match, folded, if they are few; else None."""
    found = {""}
    for op, arg in node:
        if op is rc.LITERAL:
            own: set[str] | None = {chr(arg).lower()}
        elif op is rc.IN:
            own = set()
            for o, a in arg:
                if o is rc.LITERAL:
                    own.add(chr(a).lower())
                elif o is rc.RANGE and a[1] - a[0] < 2 * WIDEST:
                    own |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    own = None
                    break
            if own is not None and len(own) > WIDEST + 1:
                own = None
        elif op is rc.SUBPATTERN:
            own = _strings(arg[3])
        elif op is rc.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            own = None if None in parts else set().union(*parts)  # type: ignore[arg-type]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] is not rc.MAXREPEAT and arg[1] <= WIDEST:
            once = _strings(arg[2])
            own = None if once is None else {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(once, repeat=k)}
        else:
            own = None
        if own is None or len(found) * len(own) > MOST:
            return None
        found = {a + b for a in found for b in own}
    return found


Clauses = list[frozenset[str]] | None  # alternatives, each a set of trigrams that must all occur; None: no demand


def _both(a: Clauses, b: Clauses) -> Clauses:
    if a is None or b is None:
        return b if a is None else a
    joined = [x | y for x in a for y in b]
    return joined if len(joined) <= MOST else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Clauses:
    clauses = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if any(not c for c in clauses) else clauses


def _demand(node: list) -> Clauses:
    demand: Clauses = None
    run: list = []
    for item in [*node, None]:
        if item is not None and _strings([*run, item]) is not None:
            run.append(item)
            continue
        if run:
            demand = _both(demand, _of_strings(_strings(run) or {""}))
            run = []
        if item is None:
            break
        if _strings([item]) is not None:
            run = [item]
            continue
        op, arg = item
        inner: Clauses = None
        if op is rc.SUBPATTERN:
            inner = _demand(arg[3])
        elif op is rc.BRANCH:
            parts = [_demand(b) for b in arg[1]]
            inner = None if None in parts else [c for p in parts for c in p]  # type: ignore[union-attr]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            inner = _demand(arg[2])
        demand = _both(demand, inner)
    return demand


def trigram_query(pattern: str) -> Clauses:
    """Alternatives of mandatory case-folded trigrams, the least among equals; None if a match may hold none of them."""
    found = _demand(list(rp.parse(pattern)))
    if found is None:
        return None
    return [c for c in dict.fromkeys(found) if not any(o < c for o in found)]


#: Letters from the commonest on: a clause is led by the trigram of its that is likely the rarest.
_COMMON = "etaoinshrdlucmfpgwybvkxqjz"


def _lead(clause: frozenset[str]) -> str:
    return max(sorted(clause), key=lambda t: sum(_COMMON.find(c) % 40 for c in t))


def _held(low: Column, trigrams: Sequence[str], number: dict[str, int]) -> Column:
    # contains() on the folded text: no window of characters is made a row
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(number[t])) for t in trigrams)))


def postings(rows: DataFrame, clauses: Sequence[frozenset[str]], number: dict[str, int]) -> DataFrame:
    """(k, tri): which trigrams a document holds, by their numbers; of documents that hold a clause's leading one at least.

    Without its leading trigram no clause can be met, so most texts are searched for those alone.
    """
    leads = sorted({_lead(c) for c in clauses})
    led = rows.select("k", F.lower("t").alias("low")).select("k", "low", F.explode(F.slice(_held(F.col("low"), leads, number), 1, 1)).alias("lead"))
    return led.select("k", F.explode(_held(F.col("low"), list(number), number)).alias("tri"))


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """(start, at, end) of a rule's matches, in code points, leftmost and without overlap."""
    groups = 2 + rule.group  # the gap before a match, the match, the rule's own groups
    whole = F.lit(rf"(?s)(.*?)(?:({rule.pattern})|\z)")
    parts = [F.regexp_extract_all(text, whole, i) for i in (1, 2, groups)]
    sized = F.arrays_zip(*(F.transform(p, F.length).alias(c) for p, c in zip(parts, "gmv")))
    step = "array<struct<start:int,at:int,end:int>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(step).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin, end = acc["pos"] + x["g"], acc["pos"] + x["g"] + x["m"]
        one = F.array(F.struct(begin.alias("start"), F.lit(at).alias("at"), end.alias("end")))
        return F.struct(end.alias("pos"), F.when((x["m"] > 0) & (x["v"] >= rule.least), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sized, start, add, lambda acc: acc["out"])


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = (*BASE, *MORE)) -> DataFrame:
    """(key, spans): spans is array<struct<start, at, end>> by start and then rule, ``at`` the rule's number.

    Positions are half-open and in code points. A null or empty text has no spans. Repeated rows are scanned alike; rows
    with a null key are in no posting and are verified against every rule; an empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries if q for c in q for t in c})
    number = {t: i for i, t in enumerate(trigrams)}
    clauses = [(n, a, number[t], len(c)) for n, q in enumerate(queries) if q for a, c in enumerate(q) for t in sorted(c)]
    asked = F.broadcast(spark.createDataFrame(clauses, "rule int, clause int, p int, need int"))  # bounded by the rules
    demanded = [c for q in queries if q for c in q]
    index = Stored(postings(rows.where("k is not null and t is not null"), demanded, number).distinct(), "postings").df
    met = index.join(asked, F.col("tri") == F.col("p")).groupBy("k", "rule", "clause").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c = need")
    candidates = met.groupBy(F.col("k").alias("c_k")).agg(F.collect_set("rule").alias("rules"))
    looked = rows.join(candidates, F.col("k") == F.col("c_k"), "left")
    t = F.coalesce(F.col("t"), F.lit(""))
    none = F.array().cast("array<struct<start:int,at:int,end:int>>")
    found = []
    for n, (rule, q) in enumerate(zip(rules, queries)):
        candidate = F.col("k").isNull() | F.array_contains("rules", n) if q else t.rlike(_cheap(rule))
        found.append(F.when(F.coalesce(candidate, F.lit(False)), _spans(t, rule, n)).otherwise(none))
    return looked.select(F.col("k").alias(key), F.array_sort(F.concat(*found)).alias("spans"))


def _cheap(rule: Rule) -> str:
    """A test that any match passes: of a rule that is one repeated class and a least length, so long a run."""
    parsed = list(rp.parse(rule.pattern))
    if rule.group == 0 and len(parsed) == 1 and parsed[0][0] is rc.MAX_REPEAT and rule.pattern.endswith("]+"):
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def joined(spans: Column, rules: Sequence[Rule] = (*BASE, *MORE)) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["at"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
