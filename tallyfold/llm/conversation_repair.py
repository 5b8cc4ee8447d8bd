"""Conversation structure repair: the cheapest edits that make roles alternate, by tables of blocks of turns.

A conversation is a string of symbols, one for each turn. The cost of what is still to come is a vector over the four
states of the pattern ``(s?(ua)+)?``; less its minimum it is one of a few vectors. For each vector and each block of
BLOCK symbols a table holds the vector before the block and what the block adds. So costs run backward over a
conversation block by block, and edits are told forward: a block's inner vectors are made again from the one at its end,
and in each state the least letter is taken that is still cheapest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Symbols of a block.
BLOCK = 4
#: States: before any turn, after a system, user and assistant turn. Where an inserted or changed turn leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
ONWARD = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of turns by their first fault; a symbol is 4 * kind + role, roles being s, u, a and others.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
ROLES = "sua"
LEAD = 64
FAR = 10**6


def kept_state(state: int, role: int) -> int | None:
    """The state after a turn that keeps its role, None if the pattern does not allow it."""
    if role == 0:
        return SYSTEM if state == START else None
    return role + 1 if role < 3 and ONWARD[state] == role + 1 else None


def _closed(raw: list[int]) -> list[int]:
    """Costs where turns may also be inserted first."""
    for _ in range(3):
        raw = [min(c, INSERT + raw[ONWARD[s]]) for s, c in enumerate(raw)]
    return raw


def _before(after: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    """The costs before a turn, less their minimum, and the minimum."""
    kind, role = divmod(symbol, 4)
    raw = [DELETE + c for c in after]
    if kind < BLANK:
        extra = CUT if kind == TRUNCATED else KEEP
        for s in range(4):
            onto = kept_state(s, role)
            raw[s] = min([raw[s], REROLE + extra + after[ONWARD[s]], *([extra + after[onto]] if onto is not None else [])])
    raw = _closed(raw)
    least = min(raw)
    return tuple(c - least for c in raw), least


class Tables:
    """All vectors of costs, and for each of them what every symbol and every block of symbols makes of it.

    Blank and duplicate turns must go, whatever their roles, so nine letters stand for the sixteen symbols.
    """

    letters = bytes([s if s < 8 else 8 for s in range(16)])

    def __init__(self) -> None:
        end = tuple(_closed([0, FAR, FAR, 0]))
        self.vectors, found, steps = [end], {end: 0}, []
        for v in self.vectors:  # grows meanwhile
            row = []
            for letter in range(9):
                new, least = _before(v, letter)
                if new not in found:
                    found[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((found[new], least))
            steps.append(row)
        one = np.array(steps)
        self.to, self.cost = one[:, :, 0], one[:, :, 1]
        # A block's letters count from its last one, which acts first: block = last + 9 * (the one before + 9 * ...).
        to, cost = self.to, self.cost
        for _ in range(BLOCK - 1):
            to, cost = self.to[to].transpose(0, 2, 1).reshape(len(to), -1), (cost[:, :, None] + self.cost[to]).transpose(0, 2, 1).reshape(len(to), -1)
        self.block_to, self.block_cost = to.tolist(), cost.tolist()
        self.told: dict[tuple, tuple[str, int]] = {}

    def blocks(self, letters: bytes) -> list[int]:
        """Numbers of the blocks of letters whose number is a multiple of BLOCK, in order."""
        return (np.frombuffer(letters, np.uint8).reshape(-1, BLOCK) @ (9 ** np.arange(BLOCK - 1, -1, -1))).tolist()

    def tell(self, letters: bytes, end: int, state: int) -> tuple[str, int]:
        """The least cheapest edits of some letters and the state after them; end: the vector behind them."""
        key = letters, end, state
        if key not in self.told:
            ids = [end]
            for letter in reversed(letters):
                ids.append(int(self.to[ids[-1], letter]))
            out = []
            for i, letter in enumerate(letters):
                here, there = self.vectors[ids[-1 - i]], self.vectors[ids[-2 - i]]
                base = int(self.cost[ids[-2 - i], letter])
                while True:
                    left = base + here[state]
                    if left == DELETE + there[state]:
                        out.append("D")
                        break
                    if here[state] == INSERT + here[ONWARD[state]]:
                        out.append("I")
                        state = ONWARD[state]
                        continue
                    kind, role = divmod(letter, 4)
                    extra, onto = CUT if kind == TRUNCATED else KEEP, kept_state(state, role)
                    kept = onto is not None and left == extra + there[onto]
                    out.append("K" if kept else "R")
                    state = onto if kept else ONWARD[state]
                    break
            if len(self.told) >= 1 << 18:
                self.told.clear()
            self.told[key] = "".join(out), state
        return self.told[key]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost and its ASCII-least edits."""
        letters = symbols.translate(self.letters + bytes(240))
        head = len(letters) % BLOCK
        numbers = self.blocks(letters[head:]) if len(letters) > head else []
        ids, total = [0], 0
        for number in reversed(numbers):
            total += self.block_cost[ids[-1]][number]
            ids.append(self.block_to[ids[-1]][number])
        first = ids[-1]
        for letter in reversed(letters[:head]):
            total += int(self.cost[first, letter])
            first = int(self.to[first, letter])
        told, state = self.tell(letters[:head], ids[-1], START)
        out = [told]
        for k in range(len(numbers)):
            at = head + k * BLOCK
            told, state = self.tell(letters[at : at + BLOCK], ids[-2 - k], state)
            out.append(told)
        while self.vectors[0][state]:
            out.append("I")
            state = ONWARD[state]
        return total + self.vectors[first][START], "".join(out)


@lru_cache(maxsize=1)
def tables() -> Tables:
    """The tables of a Python worker."""
    return Tables()


def damage(rows: DataFrame) -> DataFrame:
    """Turns with faults put in by a hash of conversation and turn: a twentieth each is dropped, emptied, loses its full stops, comes twice, or is the user's.

    Nulls are one space, in texts and roles and in what is hashed; null conversations and turns stay null.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    some = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), k.alias("k")).where("k != 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = some.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))).drop("k", "copy")


ORDER = ["conv_id", "turn", "role", "lead", "hash"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Turns with what orders them: turn, then role, then text by its first characters and a hash of conversation, role and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    some = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"))
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit("|"), F.length("role").cast("string"), F.lit("|"), "role", "text")
    return some.select("*", F.substring("text", 1, LEAD).alias("lead"), F.unhex(F.md5(told.cast("binary"))).alias("hash"))


def _symbol() -> Column:
    """The symbol of a turn that is no duplicate."""
    mark = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    kind = F.when(mark == "", BLANK).when(~mark.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    role = F.instr(F.lit(ROLES), F.left("role", F.lit(1)))
    return (4 * kind + F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1)).cast("int")


def pieces(rows: DataFrame) -> DataFrame:
    """Conversations as pieces of consecutive turns: conv_id, part, no, symbols, first and last turn, number of different turns.

    Turns are sorted over ranges, so the turns of one long conversation are spread; a piece is what one batch of a range
    holds. Where a role and text first come up is a minimum, which is combined before the shuffle; only repeated ones are joined.
    """
    keyed = _keyed(rows)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("first")).where("n > 1").select("hash", "first")
    narrow = keyed.select(*ORDER, _symbol().alias("symbol")).join(again, "hash", "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    placed = narrow.select(*ORDER, "symbol", later.alias("later")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, before = TaskContext.get().partitionId(), 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            convs, turns, hashes = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "hash"))
            symbols = b.column(b.schema.get_field_index("symbol")).to_numpy(zero_copy_only=False).astype(np.uint8)
            same = np.array([hashes[i] == (hashes[i - 1] if i else before) for i in range(n)])
            repeated = (same | b.column(b.schema.get_field_index("later")).to_numpy(zero_copy_only=False).astype(bool)) & (symbols < 4 * BLANK)
            symbols = np.where(repeated, 4 * DUPLICATE + symbols % 4, symbols).astype(np.uint8)
            before = hashes[-1]
            starts = [0, *(i for i in range(1, n) if convs[i] != convs[i - 1])]
            out = []
            for i, j in zip(starts, [*starts[1:], n], strict=True):
                known = [t for t in turns[i:j] if t is not None]
                out.append((convs[i], part, no, symbols[i:j].tobytes(), known[0] if known else None, known[-1] if known else None, len(set(known))))
                no += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _arrow(b.schema), strict=True)], schema=_arrow(b.schema))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return placed.mapInArrow(pack, f"conv_id {kinds['conv_id']}, part int, no long, symbols binary, first {kinds['turn']}, last {kinds['turn']}, turns long")


def _arrow(schema: pa.Schema) -> pa.Schema:
    conv, turn = (schema.field(c).type for c in ("conv_id", "turn"))
    return pa.schema([("conv_id", conv), ("part", pa.int32()), ("no", pa.int64()), ("symbols", pa.binary()), ("first", turn), ("last", turn), ("turns", pa.int64())])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audit(parts: list[tuple]) -> tuple:
    """The counts and edits of a conversation from its pieces in order."""
    symbols = b"".join(p[3] for p in parts)
    turns, last = 0, None
    for p in parts:
        turns += p[6] - (last is not None and p[4] == last)
        last = p[5] if p[5] is not None else last
    first = next((p[4] for p in parts if p[4] is not None), None)
    each = np.frombuffer(symbols, np.uint8)
    kinds, roles = np.bincount(each >> 2, minlength=4), each & 3
    pairs = roles[:-1] * 4 + roles[1:]
    illegal = int((~np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())
    cost, edits = tables().repair(symbols)
    return (parts[0][0], int(last - first + 1 - turns) if turns else 0, int(kinds[BLANK]), int(kinds[DUPLICATE]), int(kinds[TRUNCATED]), illegal, cost, edits)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost and audit of each conversation.

    Turns come by number, nulls first. A turn's first fault counts: blank, duplicate (role and text came before in the conversation),
    truncated. The audit's letters are K, R, D and I (kept, role changed, deleted, inserted), the ASCII-least of the cheapest. An audit is one
    value, so a conversation is told in one task, from a byte for each turn.
    """
    found = pieces(rows)
    kind, arrow = found.schema["conv_id"].dataType.simpleString(), to_arrow_type(found.schema["conv_id"].dataType)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tuple(r.values()) for b in batches for r in b.to_pylist())
        out = []
        for _, own in groupby(each, key=lambda r: r[0]):
            out.append(_audit(list(own)))
            if len(out) >= 2000:
                yield _rows(out, arrow)
                out = []
        if out:
            yield _rows(out, arrow)

    placed = found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return placed.mapInArrow(settle, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.string())], names=["conv_id", *COUNTS, "audit"])


def _followed(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns in order, side by side in one partition."""
    none = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    heads = told.select("conv_id", F.lit(0).alias("row"), *[F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "lead")], F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("string").alias("text")], *COUNTS, "audit")
    turns = _keyed(rows).select("conv_id", F.lit(1).alias("row"), "turn", "role", "lead", "hash", "text", *none, F.lit(None).cast("string").alias("audit"))
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "row", *ORDER[1:])


def _edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each letter of an audit; a deleted turn has neither."""
    state = START
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(turns)
        if edit == "D":
            yield edit, None, None
            continue
        state = SYSTEM if edit == "K" and role[:1] == "s" else ONWARD[state]
        yield edit, role if edit == "K" else NAMES[state], text


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield from b.slice(i, 256).to_pylist()


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of each edit of each conversation; deleted turns have neither role nor text."""
    told = audits(rows)
    kind, arrow = told.schema["conv_id"].dataType.simpleString(), to_arrow_type(told.schema["conv_id"].dataType)

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in groupby(_turns(batches), key=lambda r: r["conv_id"]):
            audit = next(own)["audit"]
            out = []
            for place, done in enumerate(_edited(audit, ((r["role"], r["text"]) for r in own))):
                out.append((conv, place, *done))
                if len(out) >= 256:
                    yield _edits(out, arrow)
                    out = []
            if out:
                yield _edits(out, arrow)

    return _followed(rows, told).mapInArrow(follow, f"conv_id {kind}, place long, edit string, role string, text string")


def _edits(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    c = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], kind), pa.array(c[1], pa.int64()), *[pa.array(x, pa.string()) for x in c[2:]]], names=["conv_id", "place", "edit", "role", "text"])


def _reports(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    c = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], kind), *[pa.array(x, pa.int64()) for x in c[1:7]], *[pa.array(x, pa.string()) for x in c[7:]]], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and the repaired text's sha256 of each conversation of ``original``; zeros and the empty text's if ``rows`` has no turn of it.

    Texts pass by once, in order, and are hashed as they pass; none is held. A null conversation is one of its own.
    """
    told = audits(rows)
    kind, arrow = told.schema["conv_id"].dataType.simpleString(), to_arrow_type(told.schema["conv_id"].dataType)

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in groupby(_turns(batches), key=lambda r: r["conv_id"]):
            head, digest, first = next(own), hashlib.sha256(), True
            for _, role, text in _edited(head["audit"], ((r["role"], r["text"]) for r in own)):
                if role is not None:
                    digest.update((b"" if first else b"\n") + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
                    first = False
            for _ in own:
                pass
            out.append((conv, *[head[c] for c in COUNTS], head["audit"], digest.hexdigest()))
            if len(out) >= 1000:
                yield _reports(out, arrow)
                out = []
        if out:
            yield _reports(out, arrow)

    made = _followed(rows, told).mapInArrow(follow, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    ids = original.select(F.col("conv_id").alias("_cr_id")).distinct()
    every = ids.join(made, F.col("_cr_id").eqNullSafe(F.col("conv_id")), "left")
    return every.select(
        F.col("_cr_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def conversation_report(conversations: DataFrame) -> DataFrame:
    """The report of damaged conversations, see ``damage`` and ``repair_report``."""
    return repair_report(conversations, damage(conversations))
