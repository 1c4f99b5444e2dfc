"""Secret scan over a trigram inverted index.

Every rule is a regular expression. Its parse tree gives the strings that any match must contain, and these
a Boolean query over trigrams (an OR of ANDs). The index holds, for each trigram that some rule asks for, the
keys of the documents that contain it in lower case. Intersecting postings leaves the candidates of a rule;
only they are searched with its expression. Rules without a mandatory trigram search every document.

Postings are grouped by document, so a trigram that a third of all texts contain is no hot key. The table of
queries, which is broadcast, is as long as the rules. Candidates are joined back by key and each text is searched
whole. All is DataFrame expressions; the rules are analysed once in the driver.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import doc_key, table
from secstream.session import materialise


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # for Java's and Python's regular expressions alike
    group: int = 0  # the part whose length counts
    least: int = 0  # code points; shorter matches are dropped after they were consumed


#: The order of the kinds breaks ties between spans that start together.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run of the class is matched from its first possible start, so these two bounds can go into the pattern
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: Most strings that are followed side by side, and most conjunctions of a query. Beyond them conditions are
#: left out, which can only add candidates.
MOST_STRINGS = 64


# --- from an expression to trigrams


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _least(conjunctions: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without those that ask for more than another one; one that asks for nothing makes the rest void."""
    return {c for c in conjunctions if not any(o < c for o in conjunctions)}


def _walk(nodes) -> tuple[set[str] | None, list[set[frozenset[str]]]]:
    """(all strings a sequence of parse nodes can match, or None; conditions that any match fulfils)."""
    open_strings: set[str] = {""}
    conditions: list[set[frozenset[str]]] = []
    exact = True

    def close() -> None:
        found = _least({_trigrams(s) for s in open_strings})
        if frozenset() not in found:
            conditions.append(found)
        open_strings.clear()
        open_strings.add("")

    for op, arg in nodes:
        name, strings, own = str(op), None, []
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            chars = {chr(c).lower() for kind, a in arg for c in ([a] if str(kind) == "LITERAL" else range(a[0], a[1] + 1) if str(kind) == "RANGE" else range(200))}
            strings = chars if len(chars) <= 8 and str(arg[0][0]) != "NEGATE" else None
        elif name == "AT":
            strings = {""}
        elif name == "SUBPATTERN":
            strings, own = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                strings = set().union(*(p[0] for p in parts))
            elif all(p[1] for p in parts):
                own = [_least(set().union(*(_all(p[1]) for p in parts)))]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            inside, inner_own = _walk(inner)
            if inside is not None and high == 1:
                strings = inside | ({""} if low == 0 else set())
            elif inside is not None and 0 < low <= 4 and len(inside) ** low <= MOST_STRINGS:
                repeated = {"".join(x) for x in itertools.product(inside, repeat=low)}
                if low == high:
                    strings = repeated
                else:
                    own = [_least({_trigrams(s) for s in repeated})]
            elif low > 0:
                own = inner_own
        if strings is not None and len(strings) * len(open_strings) <= MOST_STRINGS:
            joined = {a + b for a in open_strings for b in strings}
            open_strings.clear()
            open_strings.update(joined)
        else:
            exact = False
            close()
            if strings is not None:
                open_strings.clear()
                open_strings.update(strings)
            conditions += [c for c in own if frozenset() not in c]
    if exact:
        return set(open_strings), conditions
    close()
    return None, conditions


def _all(conditions: list[set[frozenset[str]]]) -> set[frozenset[str]]:
    """One OR of ANDs that holds if all ``conditions`` hold, as far as it stays short."""
    out: set[frozenset[str]] = {frozenset()}
    for c in sorted(conditions, key=len):
        if len(out) * len(c) <= MOST_STRINGS:
            out = _least({a | b for a in out for b in c})
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of lower-case ASCII trigrams, one of which any match's text contains; [] if none is mandatory."""
    strings, conditions = _walk(re._parser.parse(pattern))
    if strings is not None:
        conditions = [*conditions, _least({_trigrams(s) for s in strings})]
    conditions = [{frozenset(t for t in x if t.isascii()) for x in c} for c in conditions]
    query = _all([c for c in conditions if frozenset() not in c])
    return [] if frozenset() in query else sorted(query, key=sorted)


# --- index and candidates


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(_trigram, _key): which of ``docs`` (_key, text) contain which trigrams in lower case."""
    lower = docs.select("_key", F.lower(F.coalesce("text", F.lit(""))).alias("_lower"))
    present = F.array_compact(F.array(*(F.when(F.contains("_lower", F.lit(t)), F.lit(t)) for t in trigrams)))
    return lower.select(F.explode(present).alias("_trigram"), "_key")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(_key, _kinds): the rules for which a document holds all trigrams of some conjunction."""
    asked = [
        {"_kind": kind, "_and": k, "_trigram": t, "_bit": 1 << b, "_full": (1 << len(c)) - 1}
        for kind, query in queries.items()
        for k, c in enumerate(query)
        for b, t in enumerate(sorted(c)[:62])
    ]
    for a in asked:
        a["_full"] = min(a["_full"], (1 << 62) - 1)
    schema = "array<struct<_kind:string,_and:int,_trigram:string,_bit:bigint,_full:bigint>>"
    wanted = index.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(asked)), schema)))
    met = index.join(F.broadcast(wanted), "_trigram").groupBy("_kind", "_and", "_full", "_key").agg(F.bit_or("_bit").alias("_bits"))
    return met.filter("_bits = _full").groupBy("_key").agg(F.collect_set("_kind").alias("_kinds"))


# --- verification


def spans(text: Column, rule: Rule, order: int) -> Column:
    """All spans of a rule in a text as array<struct<start,order,kind,end>>; leftmost, not overlapping.

    The stretches between matches come from splitting at the same expression, so a match starts where the
    stretches and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, rule.pattern), F.lit(1), F.size(found)).alias("gap"),
        found.alias("found"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("counted"),
    )
    kind = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        keep = F.length(x["counted"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))
    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array<struct<start,order,kind,end>>, sorted) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Repeated rows each give their own row, null ids stay null, other
    columns are ignored, empty tables give an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("doc_id"), F.col("text")).alias("_key"), "text")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    if queries:
        trigrams = sorted({t for q in queries.values() for c in q for t in c})
        index = materialise(postings(keyed, trigrams), "trigrams")
        keyed = keyed.join(candidates(index, queries), "_key", "left")
    each = []
    for order, rule in enumerate(rules):
        to_search = F.array_contains("_kinds", rule.kind) if rule.kind in queries else text.rlike(rule.pattern)
        each.append(F.when(to_search, spans(text, rule, order)).otherwise(none))
    return keyed.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def _duck_pattern(pattern: str) -> str:
    """Without case folding beyond ASCII, and quoted for SQL."""
    fold = lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")"
    return re.sub(r"\(\?i:([^)]*)\)", fold, pattern).replace("'", "''")


def oracle() -> str:
    """The same in DuckDB's SQL, without an index."""
    each = []
    for order, r in enumerate(RULES):
        p = _duck_pattern(r.pattern)
        each.append(
            f"""SELECT doc_id, '{r.kind}' AS kind, {order} AS ord, g AS counted, {r.least} AS least,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s, length(found[i]) AS n
FROM (SELECT doc_id, gaps, found, unnest(generate_series(1, len(found))) AS i, unnest(counted) AS g
  FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {r.group}) AS counted
    FROM documents WHERE regexp_matches(text, '{p}')))"""
        )
    kinds = ", ".join(f"count(*) FILTER (WHERE kind = '{k.kind}') AS n_{k.kind}" for k in BASE)
    one = "kind || ':' || s || ':' || (s + n)"
    return f"""WITH found AS ({' UNION ALL '.join(each)}),
kept AS (SELECT * FROM found WHERE length(counted) >= least),
per AS (SELECT doc_id, {kinds}, string_agg({one}, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(BASE)}) AS base, string_agg({one}, ',' ORDER BY s, ord) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per USING (doc_id)"""
