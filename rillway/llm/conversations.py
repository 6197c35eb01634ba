"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

Roles must read as ``(s?(ua)+)?`` by their initials. Four states tell what may follow: nothing yet, after a
system turn, after a user turn, after an assistant turn. Turns are numbered within their conversation and cut
into segments of SEGMENT turns. Segments are dealt by hash; in each Arrow batch one recursive DuckDB query
advances all its segments by one turn per recursion and keeps, per state at the segment's start and per state
reached, the least cost and its edits. A conversation of several segments is composed by the same query, whose
steps are then segments instead of turns, FAN_IN of them at a time, until one is left. So no task holds a whole
conversation, however long; only its edits, one letter per turn, are one value in the end.

Edits are letters: D delete, I and J insert a user or an assistant turn, K keep, R and S change the role to
user or assistant; reports show J as I and S as R. Inserted turns stand before the turn that they precede, or at
the end. Of two different edits of the same turns at the same cost neither begins with the other, so the least
of parts is the least of the whole, and letters of one state are ordered as in the report.

Null roles and texts are one space. A null conv_id is a conversation of its own; null turns come first. Turns that
tie are ordered by role and text, repeated rows count each, and columns besides the four named are not read. A
role that begins with none of s, u, a must be changed or deleted. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.store import bounded, settle

SEGMENT, FAN_IN = 256, 64
#: Turns, and bytes of their rows, that one recursive query advances together, in whole segments.
BATCH_ROWS, BATCH_BYTES = 8192, 16 << 20
BLANKS = " \t\n\x0b\f\r"
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
INSERT_COST, ROLE_COST, DELETE_COST, TRUNCATED_COST = 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3


def _moves() -> list[tuple[int, int, str, int, bool, str | None]]:
    """(from, to, letters, cost, keeps the turn, initial needed) for one turn, inserted turns before it included."""
    insert = {START: (USER, "I"), SYSTEM: (USER, "I"), USER: (ASSISTANT, "J"), ASSISTANT: (USER, "I")}
    out = []
    for begin in insert:
        at, word = begin, ""
        for n in range(3):
            cost = INSERT_COST * n
            out.append((begin, at, word + "D", cost + DELETE_COST, False, None))
            if at == START:
                out.append((begin, SYSTEM, word + "K", cost, True, "s"))
            to, letter, initial = (ASSISTANT, "S", "a") if at == USER else (USER, "R", "u")
            out.append((begin, to, word + "K", cost, True, initial))
            out.append((begin, to, word + letter, cost + ROLE_COST, True, None))
            at, word = insert[at][0], word + insert[at][1]
    return out


#: What completes a conversation at each state: letters, cost. At the start, nothing is a whole conversation.
ENDINGS = {START: ("", 0), SYSTEM: ("IJ", 2 * INSERT_COST), USER: ("J", INSERT_COST), ASSISTANT: ("", 0)}
#: One recursion advances every segment g of ``steps`` (g, n, f, t, cost, word) by one step; only the last rows stay.
_ADVANCE = """with recursive reached(g, n, f, t, best) using key (g, f, t) as (
  select distinct g, 0::bigint, f, f, {'cost': 0::bigint, 'word': ''} from steps where n = 1 and (f = 0 or not fresh)
 union
  select r.g, r.n + 1, r.f, s.t, min({'cost': r.best.cost + s.cost, 'word': r.best.word || $between || s.word})
  from reached r join steps s on s.g = r.g and s.n = r.n + 1 and s.f = r.t group by r.g, r.n + 1, r.f, s.t)
select r.g, r.f, r.t, r.best.cost as cost, r.best.word as word from reached r join (select g, max(n) as n from steps group by g) z on z.g = r.g and z.n = r.n"""
_TURNS = """create or replace temp table steps as select r.g, r.n, m.f, m.t, m.cost + case when m.keeps and r.fault = 3 then 3 else 0 end as cost, m.word, r.fresh
 from turns r join moves m on (not m.keeps or r.fault not in (1, 2)) and (m.initial is null or m.initial = r.initial)"""
_PARTS = "create or replace temp table steps as select g, n, f, t, cost, word, fresh from turns"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of damaged conversations: what crc32 of ``conv_id:turn`` says, modulo 20.

    A dropped turn stays as a row with gone = true, so that its conversation is not forgotten."""
    space = F.lit(" ")
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    hurt = read.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return hurt.drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with n from 1, segment, initial, fault, new_turn and illegal.

    One exchange deals the rows by conversation; places, repeats and neighbours are windows that stream over
    sorted rows, so a long conversation spills and is not gathered. Gone rows come last in their conversation."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    order = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text", "again")
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    told = rows.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1).withColumn("initial", F.substring("role", 1, 1))
    told = told.withColumns({"n": F.row_number().over(order).cast("long"), "_before": F.lag("initial").over(order), "_turn": F.lag("turn").over(order)})
    fault = F.when(rest == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.substring(rest, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return told.select(
        "conv_id", "turn", "role", "text", "gone", "n", F.floor((F.col("n") - 1) / SEGMENT).alias("segment"), "initial", fault.alias("fault"),
        (F.col("turn").isNotNull() & ((F.col("n") == 1) | ~F.col("turn").eqNullSafe(F.col("_turn")))).alias("new_turn"),
        ((F.col("n") > 1) & ~F.concat("_before", "initial").isin("su", "ua", "au")).alias("illegal"),
    )


def counts(flagged: DataFrame) -> DataFrame:
    """(conv_id, turns, gaps, blank, duplicate, truncated, illegal) per conversation, of its rows that are not gone."""
    here = ~F.col("gone")
    turn = F.when(here, F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if(here & F.col("new_turn")), F.lit(0))
    fault = lambda k: F.count_if(here & (F.col("fault") == k))
    return flagged.groupBy("conv_id").agg(F.count_if(here).alias("turns"), gaps.alias("gaps"), fault(BLANK).alias("blank"), fault(DUPLICATE).alias("duplicate"), fault(TRUNCATED).alias("truncated"), F.count_if(here & F.col("illegal")).alias("illegal"))


def _advanced(steps: DataFrame, turns: bool) -> DataFrame:
    """(conv_id, segment, f, t, cost, word): ``steps`` of each segment, dealt by hash and composed in batches.

    ``steps`` has conv_id, segment, n from 1 within it and, of single turns, initial and fault, of composed
    segments f, t, cost and word. Edits of several segments stay apart by commas. Sorted segments stream through;
    a query gets whole segments of about BATCH_ROWS rows together."""
    cols = ["conv_id", "segment", "n", *(("initial", "fault") if turns else ("f", "t", "cost", "word"))]

    def solve(con: duckdb.DuckDBPyConnection, rows: pa.Table) -> pa.RecordBatch:
        conv, segment = rows["conv_id"].to_pylist(), rows["segment"].to_pylist()
        names = dict.fromkeys(zip(conv, segment, strict=True))
        for g, k in enumerate(names):
            names[k] = g
        keys = list(names)
        table = rows.drop_columns(["conv_id", "segment"]).append_column("g", pa.array([names[k] for k in zip(conv, segment, strict=True)], pa.int64()))
        table = table.append_column("fresh", pa.array([s == 0 for s in segment]))
        con.register("turns", table)
        con.execute(_TURNS if turns else _PARTS)
        con.unregister("turns")
        out = con.sql(_ADVANCE, params={"between": "" if turns else ","}).to_arrow_table()
        at = out["g"].to_pylist()
        word = out["word"] if turns else pa.array([w[1:] for w in out["word"].to_pylist()], pa.string())
        return pa.table({"conv_id": pa.array([keys[g][0] for g in at], pa.int64()), "segment": pa.array([keys[g][1] for g in at], pa.int64()), "f": out["f"].cast(pa.int64()), "t": out["t"].cast(pa.int64()), "cost": out["cost"].cast(pa.int64()), "word": word}).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        con.execute("create temp table moves(f bigint, t bigint, word varchar, cost bigint, keeps boolean, initial varchar)")
        con.executemany("insert into moves values (?, ?, ?, ?, ?, ?)", _moves())
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH_ROWS and sum(b.nbytes for b in held) < BATCH_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            last = (rows["conv_id"][-1].as_py(), rows["segment"][-1].as_py())
            cut = rows.num_rows
            while cut and (rows["conv_id"][cut - 1].as_py(), rows["segment"][cut - 1].as_py()) == last:
                cut -= 1
            if cut:
                yield from solve(con, rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            yield from solve(con, pa.Table.from_batches(held).combine_chunks())
        con.close()

    dealt = bounded(steps).select(*cols).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "n")
    return dealt.mapInArrow(run, "conv_id long, segment long, f long, t long, cost long, word string")


def plans(flagged: DataFrame) -> DataFrame:
    """(conv_id, cost, word): the least cost and its edits, the segments' apart by commas."""
    here = flagged.where(~F.col("gone")).select("conv_id", "segment", ((F.col("n") - 1) % SEGMENT + 1).alias("n"), "initial", "fault")
    parts = settle(_advanced(here, True))
    whole = []
    while True:
        last = parts.groupBy(F.col("conv_id").alias("_conv")).agg(F.max("segment").alias("_last"))
        same = F.col("conv_id").eqNullSafe(F.col("_conv"))
        whole.append(parts.join(last.where("_last = 0"), same, "left_semi"))
        more = parts.join(last.where("_last > 0"), same, "left_semi")
        if more.isEmpty():
            break
        parts = settle(_advanced(more.withColumn("n", F.col("segment") % FAN_IN + 1).withColumn("segment", F.floor(F.col("segment") / FAN_IN)), False))
    ended = whole[0]
    for more in whole[1:]:
        ended = ended.unionByName(more)
    by = lambda i: F.create_map(*(x for s, e in ENDINGS.items() for x in (F.lit(s).cast("long"), F.lit(e[i]))))[F.col("t")]
    best = F.min(F.struct((F.col("cost") + by(1)).alias("cost"), F.concat("word", by(0)).alias("word")))
    return ended.groupBy("conv_id").agg(best.alias("b")).select("conv_id", "b.cost", "b.word")


def shown(word: Column) -> Column:
    """Edits as the report shows them: initials alone, no borders of segments."""
    return F.translate(word, "JS,", "IR")


def applied(flagged: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, n, place, edit, role, text): the turns of the repaired conversations in the order of (n, place);
    edit is insert, keep or role. Each turn reads its own letters, and is dealt by its segment."""
    letters = F.split("word", ",")
    slices = plan.select(F.col("conv_id").alias("_conv"), F.size(letters).cast("long").alias("_of"), F.posexplode(letters).alias("_segment", "slice"))
    split = slices.select("_conv", "_of", F.col("_segment").cast("long"), F.regexp_extract_all("slice", F.lit("[IJ]*[DKRS]"), F.lit(0)).alias("_edits"), F.regexp_extract("slice", "[IJ]*$", 0).alias("_end"))
    rows = flagged.where(~F.col("gone")).select("conv_id", "segment", "n", "role", "text")
    met = rows.join(split, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment")))
    at = ((F.col("n") - 1) % SEGMENT + 1).cast("int")
    # the letters of the turn, and those that stand after the last turn of all
    last = (at == F.size("_edits")) & (F.col("segment") == F.col("_of") - 1)
    turn = met.select("conv_id", "n", "role", "text", F.concat(F.element_at("_edits", at), F.when(last, F.col("_end")).otherwise("")).alias("edits"))
    each = turn.select("conv_id", "n", "role", "text", F.posexplode(F.split("edits", "")).alias("place", "edit")).where("edit <> 'D' AND edit <> ''")
    kind = F.when(F.col("edit").isin("I", "J"), "insert").when(F.col("edit") == "K", "keep").otherwise("role")
    role = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("J", "S"), "assistant").otherwise(F.col("role"))
    return each.select("conv_id", "n", "place", kind.alias("edit"), role.alias("role"), F.when(kind == "insert", "").otherwise(F.col("text")).alias("text"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and the repaired turns of
    ``rows`` (conv_id, turn, role, text and, where there is such a column, gone)."""
    rows = rows if "gone" in rows.columns else rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("gone"))
    flagged = settle(with_faults(rows))
    plan = settle(plans(flagged))
    named = plan.select(F.col("conv_id").alias("_conv"), "cost", shown(F.col("word")).alias("audit"))
    report = counts(flagged).join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    report = report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    return report, applied(flagged, plan)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256): of each conversation's ``role:text`` lines in order. The digest of a conversation is a
    chain, so its turns stream through one task, which holds the state of one digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(3), batch.column(4))), strict=True):
                if chain is None or conv != now:
                    if chain is not None:
                        out.append((now, chain.hexdigest()))
                    now, chain = conv, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(f"{role}:{text}".encode())
            yield _digests(out)
        if chain is not None:
            yield _digests([(now, chain.hexdigest())])

    sorted_ = bounded(turns).select("conv_id", "n", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "n", "place")
    return sorted_.mapInArrow(run, "conv_id long, sha256 string")


def _digests(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "sha256"])


def repair_report(conversations: DataFrame) -> DataFrame:
    """The report of damaged conversations with the digest of what they are repaired to."""
    report, turns = repair(damage(conversations))
    named = digests(turns).select(F.col("conv_id").alias("_conv"), "sha256")
    met = report.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return met.select(*report.columns, F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: What ``repair_report`` gives, for the checking engine: its own recursion over whole conversations.
CHECK = r"""with recursive named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as k from conversations),
 told as (select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(length(k)), lambda i: ascii(substr(k, i + 1, 1))::ubigint)),
   lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::ubigint)), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 20 as kind from named),
 hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from told where kind <> 0),
 seen as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again from hurt),
 numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as n, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as rest from seen),
 flagged as materialized (select *, substr(role, 1, 1) as initial, case when rest = '' then 1 when again then 2 when right(rest, 1) not in ('.', '!', '?') then 3 else 0 end as fault from numbered),
 pairs as (select conv_id, concat(lag(initial) over (partition by conv_id order by n), initial) as pair, n from flagged),
 facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 1) as blank, count_if(fault = 2) as duplicate, count_if(fault = 3) as truncated, max(n) as size from flagged group by conv_id),
 bad as (select conv_id, count_if(n > 1 and pair not in ('su', 'ua', 'au')) as illegal from pairs group by conv_id),
 opened(f, m, fee, word, lines) as (values ('', '', 0, '', ''), ('', 'u', 3, 'I', chr(10) || 'user:'), ('', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', chr(10) || 'assistant:'), ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', chr(10) || 'user:')),
 st(conv_id, n, f, best) as (select conv_id, 0::bigint, '', {'cost': 0::bigint, 'audit': '', 'lines': ''} from facts
  union all
  select conv_id, n, t, min({'cost': cost, 'audit': audit, 'lines': lines}) from (
   select s.conv_id, s.n + 1 as n, e.t, s.best.cost + o.fee + e.fee + case when e.edit <> 'D' and r.fault = 3 then 3 else 0 end as cost, s.best.audit || o.word || e.edit as audit,
    s.best.lines || o.lines || case e.edit when 'D' then '' when 'K' then chr(10) || r.role || ':' || r.text else chr(10) || case e.t when 'u' then 'user' else 'assistant' end || ':' || r.text end as lines
   from st s join flagged r on r.conv_id is not distinct from s.conv_id and r.n = s.n + 1 join opened o on o.f = s.f
   join (values ('', 's', 'K', 0), ('', 'u', 'K', 0), ('s', 'u', 'K', 0), ('a', 'u', 'K', 0), ('u', 'a', 'K', 0), ('', 'u', 'R', 3), ('s', 'u', 'R', 3), ('a', 'u', 'R', 3), ('u', 'a', 'R', 3), ('', '', 'D', 4), ('s', 's', 'D', 4), ('u', 'u', 'D', 4), ('a', 'a', 'D', 4)) as e(m, t, edit, fee)
    on e.m = o.m and (e.edit = 'D' or r.fault not in (1, 2)) and (e.edit <> 'K' or r.initial = e.t)) z group by conv_id, n, t),
 ended as (select s.conv_id, min({'cost': s.best.cost + o.fee, 'audit': s.best.audit || o.word, 'lines': s.best.lines || o.lines}) as best
  from st s join facts on facts.conv_id is not distinct from s.conv_id and facts.size = s.n join opened o on o.f = s.f and (o.m = 'a' or o.m = '' and s.f = '') group by s.conv_id),
 ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
 coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(substr(coalesce(best.lines, ''), 2)) as repaired_sha256
from ids left join facts on facts.conv_id is not distinct from ids.conv_id left join bad on bad.conv_id is not distinct from ids.conv_id left join ended on ended.conv_id is not distinct from ids.conv_id"""
