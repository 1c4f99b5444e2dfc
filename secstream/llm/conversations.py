"""Conversation structure repair: the cheapest edits that give a conversation legal turns, by branch and bound.

Roles must read ``(s?(ua)+)?`` by their initials. Every row is kept, given another role or deleted, and empty
user or assistant rows may be inserted; the audit is the string of the edits' initials.

* A depth-first search with an explicit stack works on a piece of at most PIECE rows. Its suffix lower bounds are
  the least costs of the rest from each state of the grammar when nothing but costs counts. The incumbent is the
  best (cost, audit) so far. Each node, a position and a state of the grammar, keeps the best prefix that reached
  it and eliminates all worse ones. The search ends when the stack is empty, which proves the incumbent optimal.
* Two audits of the same rows, the last row's edit at their end, are never prefixes of each other. So pieces can be
  solved apart, for every state that may enter and leave them, and put together by costs and by the order of the
  audits alone. A conversation of any length is searched in pieces, wherever its rows lie.
* Structure is found on rows without texts: conversation, turn, role, digest of role and text. Equal rows of a turn
  are counted before the shuffle; all but the first are duplicates, so they are one step of the search. These rows
  are range-partitioned by conversation, turn, role and digest, so a long conversation spreads over ranges.
* Texts are shuffled once and read in order, each conversation behind its audit; a running SHA-256 takes the
  repaired lines, so no text stays in memory. A digest is a chain, hence a conversation's texts pass one task.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import table
from secstream.session import materialise

#: Rows of a piece that one search looks at, at most.
PIECE = 256
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# States of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What ends a whole conversation in each state: the cost and the rows inserted behind the last one.
END = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}

Steps = list[tuple[str, int, int]]  # class of the row, its cost if not deleted, deletions forced behind it


def _entered(state: int, initial: str) -> int | None:
    """The state after a row with this initial is kept, or None where it must not stand."""
    if initial == "s" and state == START:
        return SYSTEM
    return _NEXT[state] if (initial == "u") == (_NEXT[state] == USER) and initial in ("u", "a") else None


# A row's class is the initial of its role (s, u, a, or x for any other), or d where it must be deleted.


def edits(state: int, step: tuple[str, int, int]) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of what can be done with a row; forced deletions behind it are part of it."""
    kind, keep, behind = step
    tail, extra = "D" * behind, DELETE * behind
    out = [("D" + tail, DELETE + extra, state)]
    if kind != "d":
        entered = _entered(state, kind)
        if entered is not None:
            out.append(("K" + tail, keep + extra, entered))
        if entered != _NEXT[state]:
            out.append(("R" + tail, REROLE + keep + extra, _NEXT[state]))
    return out


NEVER = 1 << 60


def suffix_bounds(steps: Steps, ends: dict[int, tuple[int, str]]) -> list[list[int]]:
    """For every position and state a cost that the rest has at least; NEVER where no end can be reached.

    Costs alone are looked at, backwards: which of several repairs of equal cost comes first is left to the search.
    """
    low = [[ends[q][0] if q in ends else NEVER for q in range(4)]]
    for step in reversed(steps):
        after = low[-1]
        here = [min(cost + after[to] for _, cost, to in edits(q, step)) for q in range(4)]
        for _ in range(2):  # rows inserted in front of this one
            here = [min(here[q], INSERT + here[_NEXT[q]]) for q in range(4)]
        low.append(here)
    return low[::-1]


def search(steps: Steps, enter: int, ends: dict[int, tuple[int, str]]) -> tuple[int, str, int] | None:
    """(cost, audit, last state) of the best edits from state ``enter`` to one of ``ends``; of equal costs the audit
    that is least in ASCII order; None if no end can be reached."""
    low, n = suffix_bounds(steps, ends), len(steps)
    if low[0][enter] >= NEVER:
        return None
    best: tuple[int, str, int] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {(0, enter): (0, "")}
    stack = [(0, enter, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        if reached[i, q] != (cost, audit):
            continue  # a better prefix came here since
        if best is not None:
            bound = cost + low[i][q]
            if bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]:
                continue
        if i == n:
            if q in ends:
                found = (cost + ends[q][0], audit + ends[q][1], q)
                if best is None or found < best:
                    best = found
            continue
        options = [(c + low[i + 1][to], e, i + 1, to, c) for e, c, to in edits(q, steps[i])]
        options.append((INSERT + low[i][_NEXT[q]], "I", i, _NEXT[q], INSERT))
        options.sort(reverse=True)  # the most promising one is taken off the stack first
        for rest, e, j, to, c in options:
            if rest >= NEVER or best is not None and cost + rest > best[0]:
                continue
            prefix = (cost + c, audit + e)
            if (j, to) not in reached or prefix < reached[j, to]:
                reached[j, to] = prefix
                stack.append((j, to, *prefix))
    return best


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits of ``audit``."""
    state = START
    for e in audit:
        if e == "I":
            state = _NEXT[state]
            yield _ROLE[state], ""
            continue
        role, text = next(rows)
        if e == "R":
            state = _NEXT[state]
            yield _ROLE[state], text
        elif e == "K":
            state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
            yield role, text


# --- damage and faults, in Spark's own functions


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """_conv, _turn, _role, _text, _times: every row after damage; rows that damage drops have _times 0."""
    lot = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").cast("long").alias("_turn"), _filled("role").alias("_role"), _filled("text").alias("_text"), lot.alias("_lot"))
    return rows.select(
        "_conv",
        "_turn",
        F.when(F.col("_lot") == 4, "user").otherwise(F.col("_role")).alias("_role"),
        F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")).alias("_text"),
        F.when(F.col("_lot") == 0, 0).when(F.col("_lot") == 3, 2).otherwise(1).cast("long").alias("_times"),
    )


def _digest() -> Column:
    """128 bits of role and text; stands for the text in what follows."""
    return F.unhex(F.md5(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text").cast("binary")))


def _order() -> Column:
    return F.struct(F.col("_turn").isNotNull().alias("has"), F.col("_turn").alias("at"))


_SPACE = r"[\x20\x09-\x0D]"


def turns(rows: DataFrame) -> DataFrame:
    """The damaged rows without their texts, equal rows of a turn counted in _times, and what is wrong with each."""
    bare = F.regexp_replace("_text", f"{_SPACE}+$", "")
    light = rows.filter("_times > 0").select("_conv", "_turn", "_role", _digest().alias("_digest"), (F.length(bare) == 0).alias("_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("_cut"), "_times")
    light = materialise(light.groupBy("_conv", "_turn", "_role", "_digest", "_blank", "_cut").agg(F.sum("_times").alias("_times")), "turns")
    first = light.groupBy("_conv", "_digest").agg(F.min(_order()).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    first = materialise(first.select(F.col("_conv").alias("_c"), F.col("_digest").alias("_d"), "_first"), "repeated-turns")
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_digest") == F.col("_d"))
    late = F.coalesce(F.col("_first") < _order(), F.lit(False))
    return light.join(first, same, "left").select(*light.columns, late.alias("_late"))


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_PIECE = "_conv long, _has boolean, _at long, _role string, _digest binary, _whole boolean, _first string, _last string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", _costs array<long>, _audits array<string>"
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def _solved(steps: Steps, whole: bool, from_start: bool) -> tuple[list[int | None], list[str | None]]:
    """A whole conversation has one answer; of a piece there is one for each state before and after it, at 4 * before + after."""
    if whole:
        cost, audit, _ = search(steps, START, END)
        return [cost], [audit]
    costs: list[int | None] = [None] * 16
    audits: list[str | None] = [None] * 16
    for before in [START] if from_start else range(4):
        for after in range(4):
            if found := search(steps, before, {after: (0, "")}):
                costs[4 * before + after], audits[4 * before + after] = found[:2]
    return costs, audits


def pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Solved pieces (_PIECE), from ``turns``; a conversation in one range of at most ``piece`` rows is one."""
    order = ["_conv", F.col("_turn").isNotNull(), "_turn", "_role", "_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        edge = True  # the conversation may have begun in the range before

        def solve(part: list[dict], whole: bool, from_start: bool) -> tuple:
            steps, n, initials = [], dict.fromkeys(_COUNTS, 0), []
            for r in part:
                initial, times = r["_role"][:1], r["_times"]
                blank, late, cut = r["_blank"], r["_late"], r["_cut"]
                n["blank"] += times if blank else 0
                n["duplicate"] += 0 if blank else times - (0 if late else 1)
                n["truncated"] += int(cut and not blank and not late)
                kind = "d" if blank or late else initial if initial in ("s", "u", "a") else "x"
                steps.append((kind, CUT if kind != "d" and cut else 0, times - 1))
                initials.append(initial)
                n["illegal"] += times - 1  # equal neighbours
            n["illegal"] += sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
            costs, audits = _solved(steps, whole, from_start)
            one = part[0]
            return (one["_conv"], one["_turn"] is not None, one["_turn"], one["_role"], one["_digest"], whole, initials[0], initials[-1], *n.values(), costs, audits)

        def out(made: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], _NAMES)

        began = True  # held starts its conversation, as far as this range shows
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                if held and r["_conv"] != held[-1]["_conv"]:
                    made.append(solve(held, began and not edge, began and not edge))
                    held, began, edge = [], True, False
                elif len(held) == piece:
                    made.append(solve(held, False, began and not edge))
                    held, began = [], False
                held.append(r)
            if made:
                yield out(made)
        if held:
            yield out([solve(held, False, began and not edge)])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.mapInArrow(run, _PIECE), "pieces")


_REPAIR = "_conv long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string"


def joined(solved: DataFrame) -> DataFrame:
    """One _REPAIR row for each conversation, from its pieces in order.

    Along the pieces only the cost and the rank of the best audit are kept for each of the four states, and for
    each piece the state that it was entered from; audits are written out once, at the end.
    """

    def whole(part: list[dict]) -> tuple:
        counts = [sum(r[c] for r in part) for c in _COUNTS]
        counts[3] += sum(a["_last"] + b["_first"] not in ("su", "ua", "au") for a, b in itertools.pairwise(part))
        if part[0]["_whole"]:
            return (part[0]["_conv"], *counts, part[0]["_costs"][0], part[0]["_audits"][0])
        at, came = {START: (0, 0)}, []
        for r in part:
            best: dict[int, tuple] = {}
            for before, (cost, rank) in at.items():
                for after in range(4):
                    c = r["_costs"][4 * before + after]
                    if c is not None:
                        now = (cost + c, rank, r["_audits"][4 * before + after], before)
                        if after not in best or now < best[after]:
                            best[after] = now
            ranks = {k: n for n, k in enumerate(sorted({x[1:3] for x in best.values()}))}
            at = {after: (x[0], ranks[x[1:3]]) for after, x in best.items()}
            came.append({after: x[3] for after, x in best.items()})
        cost, _, state = min((c + END[q][0], rank, q) for q, (c, rank) in at.items())
        audit = [END[state][1]]
        for r, back in zip(reversed(part), reversed(came), strict=True):
            audit.append(r["_audits"][4 * back[state] + state])
            state = back[state]
        return (part[0]["_conv"], *counts, cost, "".join(reversed(audit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()]
        held: list[dict] = []

        def out(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in _REPAIR.split(", ")])

        for batch in batches:
            made = []
            for r in batch.to_pylist():
                if held and r["_conv"] != held[0]["_conv"]:
                    made.append(whole(held))
                    held = []
                held.append(r)
            if made:
                yield out(made)
        if held:
            yield out([whole(held)])

    return solved.repartition("_conv").sortWithinPartitions("_conv", "_has", "_at", "_role", "_digest").mapInArrow(run, _REPAIR)


def repair(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of
    ``conversations`` (conv_id, turn, role, text), after damage.

    Null roles and texts are one space; rows with a null conv_id are one conversation; null turns come first. Rows
    of one turn are ordered by role, then by the MD5 of role and text. Repeated rows are duplicates. Other columns
    are ignored, an empty table gives no rows, texts of any length are read whole. A conversation of which damage
    leaves nothing has zeros, an empty audit and the digest of the empty string. Gaps beyond a long count as the
    largest long.
    """
    rows = damaged(conversations)
    light = turns(rows)
    number = lambda c: F.col(c).cast("decimal(38,0)")
    gap = number("_high") - number("_low") + 1 - number("_n")
    gaps = light.groupBy("_conv").agg(F.max("_turn").alias("_high"), F.min("_turn").alias("_low"), F.count_distinct("_turn").alias("_n"))
    gaps = gaps.select(F.col("_conv").alias("_c"), F.when(F.col("_n") == 0, 0).otherwise(F.least(gap, F.lit((1 << 63) - 1).cast("decimal(38,0)"))).cast("long").alias("gaps"))
    found = joined(pieces(light, piece))
    heads = found.join(gaps, F.col("_conv").eqNullSafe(F.col("_c"))).drop("_c")
    empty = F.lit(None)
    heads = heads.select("_conv", F.lit(0).alias("_part"), empty.cast("long").alias("_turn"), empty.cast("string").alias("_role"), empty.cast("binary").alias("_digest"), empty.cast("string").alias("_text"), F.lit(0).cast("long").alias("_times"), F.struct("gaps", *_COUNTS, "cost", "audit").alias("_head"))
    kind = heads.schema["_head"].dataType
    texts = rows.select("_conv", F.lit(1).alias("_part"), "_turn", "_role", _digest().alias("_digest"), "_text", "_times", empty.cast(kind).alias("_head"))
    order = ["_conv", "_part", F.col("_turn").isNotNull(), "_turn", "_role", "_digest"]
    stream = heads.union(texts).repartition("_conv").sortWithinPartitions(*order)
    names = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.string()]
        conv, head, lines = None, None, None

        def closed() -> tuple:
            if head is None:
                return (conv, 0, 0, 0, 0, 0, 0, "", EMPTY_SHA)
            return (conv, *head.values(), lines.digest())

        for batch in batches:
            made = []
            for r in batch.select([c for c in batch.schema.names]).to_pylist():
                if lines is None or r["_conv"] != conv:
                    if lines is not None:
                        made.append(closed())
                    conv, head = r["_conv"], r["_head"]
                    lines = _Lines(head["audit"] if head else "")
                for _ in range(r["_times"]):
                    lines.take(r["_role"], r["_text"])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)
        if lines is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), kinds, strict=True)], names)

    return stream.mapInArrow(run, "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string, repaired_sha256 string")


class _Lines:
    """A running digest of the repaired conversation, fed row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:".encode("utf-8", "surrogatepass"))
        self.sha.update(text.encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _NEXT[self.state]
            self._add(_ROLE[self.state], "")

    def take(self, role: str, text: str) -> None:
        self._inserted()
        e = self.audit[self.at]
        self.at += 1
        if e == "R":
            self.state = _NEXT[self.state]
            self._add(_ROLE[self.state], text)
        elif e == "K":
            self.state = SYSTEM if role[:1] == "s" else _NEXT[self.state]
            self._add(role, text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


_SQL_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
#: The same as a forward table over all positions and states, with SQL's recursion; a state is the last initial.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS tab
  FROM range(256) AS t(k)),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes
  FROM conversations),
lots AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot
  FROM src, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM lots, range(2) AS t(copy) WHERE lot <> 0 AND (copy = 0 OR lot = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i,
         rtrim(text, {_SQL_SPACE}) AS bare FROM damaged),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
edits AS (
  SELECT * FROM (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) AS t(q, nxt)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS q, 0::BIGINT AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS rn FROM (
      WITH fed AS (
        SELECT w.conv_id, w.i + 1 AS i, CASE k WHEN 0 THEN w.q WHEN 1 THEN e.nxt ELSE f.nxt END AS q, w.cost + 5 * k AS cost, w.audit || repeat('I', k::INTEGER) AS audit
        FROM walk AS w JOIN edits AS e ON e.q = w.q JOIN edits AS f ON f.q = e.nxt, range(3) AS t(k)),
      met AS (
        SELECT fed.*, faults.initial, faults.fault, edits.nxt, CASE WHEN faults.fault = 'truncated' THEN 5 ELSE 0 END AS cut
        FROM fed JOIN faults ON faults.conv_id IS NOT DISTINCT FROM fed.conv_id AND faults.i = fed.i JOIN edits ON edits.q = fed.q)
      SELECT conv_id, i, q, cost + 2 AS cost, audit || 'D' AS audit FROM met
      UNION ALL
      SELECT conv_id, i, initial, cost + cut, audit || 'K' FROM met
      WHERE fault NOT IN ('blank', 'duplicate') AND initial <> '' AND q || initial IN ('s', 'u', 'su', 'ua', 'au')
      UNION ALL
      SELECT conv_id, i, nxt, cost + cut + 1, audit || 'R' FROM met WHERE fault NOT IN ('blank', 'duplicate')))
  WHERE rn = 1),
ended AS (
  SELECT conv_id, cost, audit FROM (
    SELECT conv_id, cost, audit, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS rn FROM (
      SELECT walk.conv_id, cost + CASE q WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END AS cost, audit || CASE q WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit
      FROM walk JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id AND counts.n = walk.i))
  WHERE rn = 1),
marks AS (
  SELECT conv_id, k, audit[k] AS e, length(regexp_replace(audit[:k], 'I', '', 'g')) AS i,
         count(*) FILTER (audit[k] <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS p
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM ended)),
lines AS (
  SELECT m.conv_id, m.k, m.p, m.e, CASE WHEN m.e = 'I' THEN '' ELSE f.text END AS text, f.role,
         coalesce(first_value(CASE WHEN m.e = 'K' THEN f.initial END) OVER (PARTITION BY m.conv_id ORDER BY m.k), '') = 's' AS s
  FROM marks AS m LEFT JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i
  WHERE m.e <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (p - s::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS repaired
  FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def brute_force(rows: list[tuple[int | None, int | None, str | None, str | None]]) -> dict:
    """The result for each conversation by a forward table over all nodes and plain loops: for tests."""
    space, convs = " \t\n\v\f\r", {}
    for conv, turn, role, text in rows:
        of = convs.setdefault(conv, [])
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 1:
            text = ""
        if lot == 2:
            text = "".join(c for c in text if c not in ".!?")
        if lot == 4:
            role = "user"
        of += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    out = {}
    for conv, of in convs.items():
        md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r)))
        at = [t for t, _, _ in of if t is not None]
        n, seen, classes = dict.fromkeys(_COUNTS, 0), set(), []
        for _, role, text in of:
            bare = text.strip(space)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            classes.append((role[:1], fault))
        n["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(classes))
        best = {"": (0, "")}  # the state is the last initial
        for initial, fault in classes:
            spread = dict(best)
            for _ in range(2):
                for q, (c, a) in list(spread.items()):
                    to = "a" if q == "u" else "u"
                    spread[to] = min(spread.get(to, (1 << 30, "")), (c + 5, a + "I"))
            best = {}
            for q, (c, a) in spread.items():
                options = [(q, c + 2, a + "D")]
                if fault not in ("blank", "duplicate"):
                    cost = c + (5 if fault else 0)
                    if initial and q + initial in ("s", "u", "su", "ua", "au"):
                        options.append((initial, cost, a + "K"))
                    for to in "ua":
                        if q + to in ("u", "su", "ua", "au"):
                            options.append((to, cost + 1, a + "R"))
                for to, cost, audit in options:
                    best[to] = min(best.get(to, (1 << 30, "")), (cost, audit))
        ends = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
        cost, audit = min((c + ends[q][0], a + ends[q][1]) for q, (c, a) in best.items())
        text = "\n".join(f"{r}:{t}" for r, t in repaired(((r, t) for _, r, t in of), audit))
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out[conv] = (gaps, *n.values(), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out
