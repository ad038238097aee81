"""Conversation structure repair by a tight-arc graph searched from both ends.

A conversation's rows are to read (system)? (user assistant)+, or nothing. Nodes are (rows read,
what was said last), arcs are edits: Keep costs 0, Rerole 2, Delete 3 and Insert 2; a truncated
row that stays costs 1 more, and blank or duplicate rows must go. Minimum costs from the start
to each node and from each node to the end tell which arcs lie on a cheapest path: those whose
two costs and own cost make the least total. Going through these tight arcs with the set of
nodes that the letters so far can lead to, and taking the least letter that leaves it, gives the
cheapest edits that are least in ASCII order.

Rows come by turn (nulls first), then role and SHA-256 of the text. They are sorted by ranges
without their texts, and cut into blocks of at most BLOCK rows of one conversation, so one that
holds a third of all rows is spread over tasks. Costs over a block are a 4 by 4 matrix in the
(min, +) algebra, and a block maps sets of nodes to sets; so the costs and sets at the ends of
blocks are scans over one small row per block, and the blocks are searched apart from each other.
Texts move once, to the stream that puts a repaired conversation in order behind its edits; that
stream alone is read by one task for each conversation, row by row, as its digest must be.

Defined cases: null roles and texts are one space; a null conversation is one of its own; a null
turn comes first and counts for no gap; an empty role can't be kept; of equal rows the first
counts; an empty table gives an empty result; columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tofcube.llm.common import bound_batches, work_table

#: log2 of the rows of a block.
BLOCK = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 40
#: States: nothing said yet, or system, user or assistant last. SAID[state][initial] and NEXT[state] name the state after a row, -1 none.
SAID = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, None] + b).min(-2)


def _matrices() -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs of insertions alone, and for each code of a row those of insertions before it and its edit."""
    put = np.full((4, 4), FAR)
    for q in range(4):
        put[q, NEXT[q]], put[q, q] = INSERT, 0
    put = _least(put, put)
    rows = []
    for code in range(12):
        initial, fault = divmod(code, 3)
        edit = np.full((4, 4), FAR)
        for q in range(4):
            for _, cost, to in _edits(q, initial, fault):
                edit[q, to] = min(edit[q, to], cost)
        rows.append(np.minimum(_least(put, edit), FAR))
    return put, rows


def _edits(q: int, initial: int, fault: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row; fault: 0 none, 1 truncated, 2 must go."""
    out = [("D", DELETE, q)]
    if fault < 2:
        if SAID[q][initial] >= 0:
            out.append(("K", KEEP + TRUNCATED * fault, SAID[q][initial]))
        out.append(("R", REROLE + TRUNCATED * fault, NEXT[q]))
    return out


PUT, ROW = _matrices()
#: Costs from each state to the end of the conversation.
LAST = PUT[:, list(ENDS)].min(1)
START = np.array([0, FAR, FAR, FAR])
_EDITS = [[_edits(q, *divmod(code, 3)) for q in range(4)] for code in range(12)]


def block_matrix(codes: list[int]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for c in codes:
        m = np.minimum(_least(m, ROW[c]), FAR)
    return m


def trace(codes: list[int], arrive: np.ndarray, leave: np.ndarray, total: int, last: bool, starts: list[int] | None = None) -> dict[int, tuple[str, int]]:
    """For sets of states (bit masks) with which a block can be entered: the letters chosen in it and the set that it is left with.

    arrive and leave are the least costs from the conversation's start to the block's first node
    and from its last node to the conversation's end; only nodes of the total are on a cheapest path."""
    ahead, behind = [np.minimum((arrive[:, None] + PUT).min(0), FAR)], [leave]
    for c in codes[:-1]:
        ahead.append((ahead[-1][:, None] + ROW[c]).min(0))
        ahead[-1] = np.minimum((ahead[-1][:, None] + PUT).min(0), FAR)
    for c in reversed(codes):
        behind.append(np.minimum((ROW[c] + behind[-1]).min(1), FAR))
    behind.reverse()
    # behind[i]: before row i, insertions to come; behind[-1] is that of the block's end
    tight: list[dict[str, list[int]]] = []  # of each node before a row: letter to targets of each state, -1 none
    for i, c in enumerate(codes):
        f, g, h = ahead[i].tolist(), behind[i].tolist(), behind[i + 1].tolist()
        arcs: dict[str, list[int]] = {}
        for q in range(4):
            if f[q] + g[q] != total:
                continue
            if f[q] + INSERT + g[NEXT[q]] == total:
                arcs.setdefault("I", [-1] * 4)[q] = NEXT[q]
            for letter, cost, to in _EDITS[c][q]:
                if f[q] + cost + h[to] == total:
                    arcs.setdefault(letter, [-1] * 4)[q] = to
        tight.append(arcs)
    if starts is None:
        here = sum(1 << q for q in range(4) if arrive[q] + behind[0][q] == total)
        starts = [s for s in range(1, 16) if s & here == s]
    out = {}
    for s in starts:
        letters, at = [], s
        for arcs in tight:
            while True:
                letter, to = min((x, t) for x, t in ((x, _step(at, t)) for x, t in arcs.items()) if t)
                letters.append(letter)
                at = to
                if letter != "I":
                    break
        while last and not at & 0b1001:
            letters.append("I")
            at = _step(at, list(NEXT))
        out[s] = "".join(letters), at
    return out


def _step(states: int, to: list[int]) -> int:
    return sum({1 << to[q] for q in range(4) if states >> q & 1 and to[q] >= 0})


def _batches(df: DataFrame, schema: str, names: list[str], each) -> DataFrame:
    """conv, and what `each` gives for the other values of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [each(*values) for values in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["conv", *names])

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
    return df.mapInArrow(run, f"conv {df.schema['conv'].dataType.simpleString()}, {schema}")


def _matrix_row(block: int, codes: str) -> tuple:
    own = [ord(c) - 65 for c in codes]
    kinds = "".join("sua-"[c // 3] for c in own)
    return block, block_matrix(own).ravel().tolist(), sum(kinds[i : i + 2] not in ("su", "ua", "au") for i in range(len(kinds) - 1)), kinds[0], kinds[-1]


def _scan_costs(blocks: list[dict]) -> tuple:
    """For a conversation's blocks in order: (block, first, last, arrive, leave) each, the total, and the illegal pairs."""
    ms = [np.array(b["m"]).reshape(4, 4) for b in blocks]
    ahead, behind = [START], [LAST]
    for m in ms:
        ahead.append(np.minimum((ahead[-1][:, None] + m).min(0), FAR))
    for m in reversed(ms):
        behind.append(np.minimum((m + behind[-1]).min(1), FAR))
    total, k = int(behind[-1][0]), len(blocks)
    pairs = sum(b["inner"] for b in blocks) + sum(x["tail"] + y["head"] not in ("su", "ua", "au") for x, y in zip(blocks, blocks[1:], strict=False))
    ends = [{"block": b["block"], "first": i == 0, "last": i == k - 1, "arrive": ahead[i].tolist(), "leave": behind[k - 1 - i].tolist()} for i, b in enumerate(blocks)]
    return ends, total, pairs


def _trace_row(block: int, codes: str, first: bool, last: bool, arrive: list[int], leave: list[int], total: int) -> tuple:
    found = trace([ord(c) - 65 for c in codes], np.array(arrive), np.array(leave), total, last, [1] if first else None)
    return block, list(found), [x for x, _ in found.values()], [x for _, x in found.values()]


def _scan_sets(blocks: list[dict]) -> tuple:
    """Which of its sets each block is entered with."""
    out, at = [], 1
    for b in blocks:
        k = b["starts"].index(at)
        out.append({"block": b["block"], "k": k})
        at = b["stops"][k]
    return (out,)


def faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is truncated: its last character but white space is none of .!?"""
    bare = F.rtrim(text, F.lit(SPACE))
    return F.length(bare) == 0, ~F.substring(bare, -1, 1).isin(".", "!", "?")


def _ordered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, at, code and fault flags of each row, in order, without texts."""
    blank, cut = faults(F.col("text"))
    order = ["conv", "turn", "role", "digest", "row"]
    light = rows.select("conv", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"), F.monotonically_increasing_id().alias("row"))
    light = light.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id())
    light = work_table(light, "turn-order")
    # one first row for each text of a conversation: joined by place, so a text of very many rows is no hot key
    firsts = light.where("NOT blank").groupBy("conv", "role", "digest").agg(F.min("at").alias("first"))
    light = light.join(firsts.select("first"), F.col("at") == F.col("first"), "left")
    repeat = ~F.col("blank") & F.col("first").isNull()
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))  # 1, 2, 3; an empty role gives 1 and is told apart
    kind = F.when((F.length("role") == 0) | (initial == 0), F.lit(3)).otherwise(initial - 1)
    fault = F.when(F.col("blank") | repeat, 2).when(F.col("cut"), 1).otherwise(0)
    return light.select("conv", "turn", "role", "digest", "at", F.char(F.lit(65) + kind * 3 + fault).alias("code"), "blank", repeat.alias("repeat"), (fault == 1).alias("cut"))


def edits(light: DataFrame) -> DataFrame:
    """One row per block: conv, turn, role and digest of its first row, letters, total and pairs of its conversation."""
    blocks = light.groupBy("conv", F.shiftright("at", BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]), "").alias("codes"), F.min(F.struct("at", "turn", "role", "digest")).alias("head"))
    blocks = work_table(blocks, "turn-blocks")
    ms = _batches(blocks.select("conv", "block", "codes"), "block bigint, m array<bigint>, inner bigint, head string, tail string", ["block", "m", "inner", "head", "tail"], _matrix_row)
    # a small row for each block of a conversation
    ends = "array<struct<block:bigint,first:boolean,last:boolean,arrive:array<bigint>,leave:array<bigint>>>"
    scanned = _batches(ms.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "m", "inner", "head", "tail"))).alias("b")), f"ends {ends}, total bigint, pairs bigint", ["ends", "total", "pairs"], _scan_costs)
    scanned = scanned.select(F.col("conv").alias("s_conv"), F.inline("ends"), "total", "pairs").withColumnRenamed("block", "s_block")
    joined = blocks.join(scanned, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("block") == F.col("s_block")))
    joined = work_table(joined.select("conv", "block", "codes", "first", "last", "arrive", "leave", "total", "pairs", "head"), "turn-costs")
    traced = _batches(joined.select("conv", "block", "codes", "first", "last", "arrive", "leave", "total"), "block bigint, starts array<int>, letters array<string>, stops array<int>", ["block", "starts", "letters", "stops"], _trace_row)
    traced = work_table(traced, "turn-traces")
    chosen = _batches(traced.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "starts", "stops"))).alias("b")), "sets array<struct<block:bigint,k:int>>", ["sets"], _scan_sets)
    chosen = chosen.select(F.col("conv").alias("c_conv"), F.inline("sets")).withColumnRenamed("block", "c_block")
    same = lambda x: F.col("conv").eqNullSafe(F.col(f"{x}_conv")) & (F.col("block") == F.col(f"{x}_block"))
    out = traced.join(chosen, same("c")).select(F.col("conv").alias("t_conv"), F.col("block").alias("t_block"), F.get("letters", F.col("k")).alias("letters"))
    return joined.join(out, same("t")).select("conv", "head.turn", "head.role", "head.digest", "letters", "total", "pairs")


def _stream(rows: DataFrame, light: DataFrame) -> DataFrame:
    """Each conversation's edits and texts in one task, in order: kind 0 holds the letters of a block, kind 1 a row's text."""
    plan = edits(light).select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), F.col("letters").alias("text"), "total", "pairs")
    texts = rows.select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), "text", F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("pairs"))
    both = plan.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind")
    return both.select("conv", "kind", "role", "text", "total", "pairs")


class _Reader:
    """One conversation read from its stream: letters wait until their rows come."""

    def __init__(self, conv):
        self.conv, self.letters, self.audit, self.state, self.n = conv, deque(), [], 0, 0

    def rows(self, text: str | None = None, role: str = "") -> Iterator[tuple[int, str, str, str]]:
        """(ordinal, role, text, letter) of what stands in the repaired conversation, up to this row, or to the end."""
        while self.letters:
            letter = self.letters.popleft()
            if letter != "D":
                if letter != "K":
                    self.state = NEXT[self.state]
                    said = "assistant" if self.state == 3 else "user"
                else:
                    self.state, said = SAID[self.state]["sua".index(role[0])], role
                yield self.n, said, "" if letter == "I" else text, letter
                self.n += 1
            if letter != "I":
                break


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Reader, Iterator[tuple[int, str, str, str]], tuple | None]]:
    """(reader, its next rows, what its last block said where it ends here)."""
    now, facts = None, None
    for b in batches:
        for conv, kind, role, text, total, pairs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv != now.conv:
                if now:
                    yield now, now.rows(), facts
                now = _Reader(conv)
            if kind == 0:
                now.letters.extend(text)
                now.audit.append(text)
                facts = (total, pairs)
            else:
                yield now, now.rows(text, role), None
    if now:
        yield now, now.rows(), facts


def _named(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def repaired_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, ordinal (from 0), role, text, edit (K, R or I): the repaired conversations."""
    rows = _named(df, conv_col, turn_col, role_col, text_col)
    stream = _stream(rows, _ordered(rows))
    kind = stream.schema["conv"].dataType
    size = 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["conv", "ordinal", "role", "text", "edit"])
        out = []
        for reader, found, _ in _read(batches):
            out += [(reader.conv, *r) for r in found]
            if len(out) >= size:
                yield batch(out)
                out = []
        yield batch(out)

    bound_batches(df.sparkSession)
    return stream.mapInArrow(run, f"conv {kind.simpleString()}, ordinal bigint, role string, text string, edit string").withColumnRenamed("conv", conv_col)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    rows = _named(df, conv_col, turn_col, role_col, text_col)
    light = work_table(_ordered(rows), "turn-codes")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = light.groupBy("conv").agg(F.coalesce(turns, F.lit(0)).cast("bigint").alias("gaps"), *[F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("repeat", "duplicate"), ("cut", "truncated"))])
    stream = _stream(rows, light)
    kind = stream.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.string()]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["conv", "illegal", "cost", "audit", "sha"])
        out, digest = [], hashlib.sha256()
        for reader, found, facts in _read(batches):
            for k, role, text, _ in found:
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            if facts:
                out.append((reader.conv, facts[1], facts[0], "".join(reader.audit), digest.hexdigest()))
                digest = hashlib.sha256()
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
        yield batch(out)

    bound_batches(df.sparkSession)
    read = stream.mapInArrow(run, f"conv {kind.simpleString()}, illegal bigint, cost bigint, audit string, sha string")
    read = read.withColumnRenamed("conv", "r_conv")
    out = stats.join(read, F.col("conv").eqNullSafe(F.col("r_conv")))
    return out.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
