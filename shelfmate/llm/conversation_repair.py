"""Conversation repair: the cheapest edits that make roles alternate, least audit first.

A repaired conversation is empty or ``s?(ua)+`` in role initials. Per turn, Keep costs 0, Rerole (to user or assistant) 1, Delete
2; an Insert of an empty user or assistant turn costs 5 anywhere. Blank and duplicate turns must go; a truncated
turn that stays adds 5. The audit is the initials of the edits in order; among the cheapest the ASCII-least is taken.

Rows are numbered by a range sort over conversation and turn, never by a window over a conversation, and packed into segments: one
byte a turn (role and fault), at most SEGMENT turns. A conversation cut by a partition border or by that length has several.

Cost DP. A node is (turn, role state before it); costs to go are worked out backwards over all segments of a batch
at once. A segment in the middle of a conversation first gives its 4 x 4 table of costs from state to state; one pass over those
tables (one row for SEGMENT turns) gives every segment the costs that follow it.

Prefix-doubling ranking. An arc is optimal where its cost and the cost to go behind it make up the node's own. Every node of the
optimal arcs is ranked by the first letter of its audit, then by the first 2, 4, 8, ... letters: the rank of twice the length
is the pair (own rank, rank of the node that the doubled pointer reaches). A state and an edit fix the next state, so
two optimal arcs of a node never begin with one letter, and the least letter selects. The audit of a start is read off by jumping along
the doubled pointers; starts of a batch with one final rank have one audit, which is read once.

The repaired text is hashed turn by turn from a sorted stream, so a conversation is never held. (SHA-256 is sequential; the hash of
one conversation is the work of one task. Its audit is one value of the result and one letter per turn.)

Defined results: a null role or text is one space, also conv_id and turn where they are hashed for damage; rows with a null
conv_id are one conversation. Turns that repeat come by role, then text (its first 256 characters, then its SHA-256). An empty role
or one with another initial is never kept. Repeated rows are duplicates. A conversation without rows gets zeros, an empty audit and the
hash of the empty text. An empty table gives no rows. Only conv_id, turn, role and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmate.llm.common import prepare, read_table, through_table
from shelfmate.operators.joins import splittable_join

SEGMENT = 4096
#: Turns whose nodes are ranked together.
TURNS_AT_ONCE = 1 << 15

SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, TRUNCATED, REMOVE = range(3)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: nothing yet, after a system, a user, an assistant turn. What a new or reroled turn leads to, and what a kept role does.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
KEEP = np.array([[AFTER_S, -1, -1, -1], [AFTER_U, AFTER_U, -1, AFTER_U], [-1, -1, AFTER_A, -1], [-1, -1, -1, -1]])
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}
#: Costs after the last turn: a user waits for an answer, a system turn for a user and an answer.
FINAL = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
FAR = np.int64(1) << 40
LETTERS = np.frombuffer(b"DIKR", dtype=np.uint8)

_WHITE = " \t\n\x0b\x0c\r"


# --- rows ---------------------------------------------------------------------------------------


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text): ``conv`` is a text that is never null; nulls of role and text are one space."""
    conv = F.when(F.col("conv_id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("conv_id").cast("string")))
    return conversations.select(conv.alias("conv"), "conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``keyed`` damaged by the hash of conversation and turn; ``copies`` says how often a row stands."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    harm = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("_harm") == 1, F.lit("")).when(F.col("_harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.withColumn("_harm", harm)
        .where("_harm <> 0")
        .select(
            "conv", "turn", F.when(F.col("_harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.when(F.col("_harm") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )


def mark_faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows (conv, turn, role, text, copies), with ``blank``, ``fresh`` and ``truncated``.

    ``fresh``: the first copy's role and text were not seen earlier. All other copies are duplicates.
    """
    each = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("hash", F.sha2("text", 256))
    each = through_table(each, "conversation-rows")
    seen = each.groupBy("conv", "role", "hash").agg(F.max(F.col("turn").isNull()).alias("_untimed"), F.min("turn").alias("_first"))
    body = F.rtrim("text", F.lit(_WHITE))
    fresh = F.when(F.col("_untimed"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_first"))
    return splittable_join(each, seen, ["conv", "role", "hash"], "inner").select(
        "conv", "turn", "role", "text", "hash", "copies", (body == "").alias("blank"), fresh.alias("fresh"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )


def count_faults(marked: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated)."""
    whole, fresh = ~F.col("blank"), F.col("fresh").cast("long")
    per_turn = marked.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(whole, F.col("copies") - fresh).otherwise(0)).alias("duplicate"),
        F.sum(F.when(whole & F.col("truncated"), fresh).otherwise(0)).alias("truncated"),
    )
    return per_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )


# --- segments ------------------------------------------------------------------------------------

PACKED = "conv string, part int, seg int, place int, role string, text string, codes binary"


def _packer(segment: int):
    """Sorted rows to segments of codes, and the rows that may stay with their place in a segment."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches):
        part = TaskContext.get().partitionId()
        conv, seg, codes = None, 0, bytearray()

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([conv]), pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([None], pa.int32()),
                 pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([bytes(codes)], pa.binary())],
                names=names,
            )

        for batch in batches:
            segs, places = [], []
            for here, lead, rest, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if here != conv or len(codes) == segment:
                    if conv is not None:
                        yield close()
                    seg, codes = (0 if here != conv else seg + 1), bytearray()
                    conv = here
                segs.append(seg)
                places.append(len(codes))
                codes.append(lead)
                copies -= 1
                while copies:
                    if len(codes) == segment:
                        yield close()
                        seg, codes = seg + 1, bytearray()
                    more = min(copies, segment - len(codes))
                    codes.extend(bytes([rest]) * more)
                    copies -= more
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(segs), pa.int32()), pa.array(segs, pa.int32()), pa.array(places, pa.int32()),
                 batch.column(4), batch.column(5), pa.nulls(len(segs), pa.binary())],
                names=names,
            )
            yield rows.filter(batch.column(5).is_valid())
        if conv is not None:
            yield close()

    return run


def pack(marked: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments (``codes`` given) and the rows that may stay (``text`` given) of ``mark_faults``, by PACKED."""
    prepare(marked.sparkSession)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    stays = ~F.col("blank") & F.col("fresh")
    fault = F.when(~stays, REMOVE).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    order = ["conv", F.asc_nulls_first("turn"), "role", "_head", "hash"]
    rows = marked.withColumn("_head", F.substring("text", 1, 256)).repartitionByRange(*order).sortWithinPartitions(*order)
    lead, rest = (role + 4 * fault).cast("int"), (role + 4 * REMOVE).cast("int")
    coded = rows.select("conv", lead.alias("lead"), rest.alias("rest"), "copies", "role", F.when(stays, F.col("text")).alias("text"))
    return coded.mapInArrow(_packer(segment), PACKED)


# --- costs and ranks -------------------------------------------------------------------------------


class Nodes:
    """The nodes of several segments: a row per turn and one behind the last, a column per state."""

    def __init__(self, codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray):
        """``ends``: costs after each segment by state; ``last``: nothing follows, so turns may be inserted at the end."""
        self.sizes = np.array([len(c) for c in codes], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])
        self.stop = self.begin + self.sizes
        self.last = last
        code = np.full(int((self.sizes + 1).sum()), 4 * REMOVE + OTHER, dtype=np.int64)
        for at, c in zip(self.begin, codes):
            code[at : at + len(c)] = c
        self.role, self.fault = code & 3, code >> 2
        self.cost = np.full((len(code), 4), FAR, dtype=np.int64)
        self.cost[self.stop] = ends
        longest = np.argsort(-self.sizes, kind="stable")
        ascending = -self.sizes[longest]
        for back in range(1, int(self.sizes.max(initial=0)) + 1):
            rows = self.stop[longest[: np.searchsorted(ascending, -back, side="right")]] - back
            self.cost[rows] = self._before(rows)

    def _edits(self, rows: np.ndarray) -> list[np.ndarray]:
        """Costs to go of deleting, keeping and reroling these turns, by state."""
        after = self.cost[rows + 1]
        role, fault = self.role[rows], self.fault[rows]
        stay = np.where(fault == REMOVE, FAR, np.where(fault == TRUNCATED, CUT_OFF, 0))[:, None]
        kept = KEEP[role]
        keep = np.where(kept >= 0, stay + np.take_along_axis(after, np.maximum(kept, 0), axis=1), FAR)
        return [DELETE + after, np.minimum(keep, FAR), np.minimum(REROLE + stay + after[:, NEXT], FAR)]

    def _before(self, rows: np.ndarray) -> np.ndarray:
        cost = np.minimum.reduce(self._edits(rows))
        # At most one inserted turn leads from user to assistant or back; two lead from the start.
        user = np.minimum(cost[:, AFTER_U], INSERT + cost[:, AFTER_A])
        assistant = np.minimum(cost[:, AFTER_A], INSERT + cost[:, AFTER_U])
        cost[:, AFTER_U], cost[:, AFTER_A] = user, assistant
        for state in (START, AFTER_S):
            cost[:, state] = np.minimum(cost[:, state], INSERT + user)
        return np.minimum(cost, FAR)

    def rank(self) -> None:
        """Least letters, pointers by doubled lengths, lengths of audits and final ranks of all nodes."""
        count = len(self.cost)
        ends = np.zeros(count, dtype=bool)
        ends[self.stop] = True
        turns = np.flatnonzero(~ends)
        node = np.arange(4 * count).reshape(count, 4)
        target = np.repeat(node[:, :, None], 4, axis=2)
        optimal = np.zeros((count, 4, 4), dtype=bool)
        delete, keep, rerole = self._edits(turns)
        reached = self.cost[turns] < FAR
        below = node[turns + 1]
        kept = np.maximum(KEEP[self.role[turns]], 0)
        for letter, (cost, to) in {0: (delete, below), 2: (keep, np.take_along_axis(below, kept, axis=1)), 3: (rerole, below[:, NEXT])}.items():
            optimal[turns, :, letter] = reached & (cost == self.cost[turns])
            target[turns, :, letter] = to
        open_end = np.ones(count, dtype=bool)
        open_end[self.stop] = self.last
        inserted = self.cost[:, NEXT] + INSERT
        optimal[:, :, 1] = open_end[:, None] & (self.cost < FAR) & (inserted == self.cost)
        target[:, :, 1] = node[:, NEXT]
        going = optimal.any(axis=2)
        first = optimal.argmax(axis=2)
        self.letter = np.where(going, first, 0).ravel()
        pointer = np.where(going, np.take_along_axis(target, first[:, :, None], axis=2)[:, :, 0], node).ravel()
        length = going.ravel().astype(np.int64)
        rank = np.where(going, first + 1, 0).ravel()
        self.pointers = []
        while True:
            self.pointers.append(pointer)
            doubled = length + length[pointer]
            pairs = rank * (rank.max() + 1) + rank[pointer]
            rank = np.unique(pairs, return_inverse=True)[1].reshape(-1)
            if (doubled == length).all():
                break
            pointer, length = pointer[pointer], doubled
        self.length, self.ranks = length, rank

    def audits(self, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least audit from each start node, and the node it ends in."""
        _, one, which = np.unique(self.ranks[starts], return_index=True, return_inverse=True)
        sizes = self.length[starts[one]]
        at = np.repeat(starts[one], sizes)
        step = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for power, pointer in enumerate(self.pointers):
            jump = (step >> power) & 1 == 1
            at[jump] = pointer[at[jump]]
        text = LETTERS[self.letter[at]].tobytes().decode()
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        texts = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return [texts[w] for w in which.reshape(-1)], self.pointers[-1][starts]


def _groups(codes: list) -> list[slice]:
    """Runs of segments of at most TURNS_AT_ONCE turns together (or one segment)."""
    out, begin, turns = [], 0, 0
    for i, c in enumerate(codes):
        if i > begin and turns + len(c) > TURNS_AT_ONCE:
            out.append(slice(begin, i))
            begin, turns = i, 0
        turns += len(c)
    return out + [slice(begin, len(codes))] if codes else out


def _transfer(frames):
    """Costs from state to state over a segment, and the roles at its ends."""
    for frame in frames:
        codes = [np.frombuffer(c, dtype=np.uint8) for c in frame.codes]
        costs = []
        for group in _groups(codes):
            part = codes[group]
            ways = []
            for state in range(4):
                ends = np.full((len(part), 4), FAR, dtype=np.int64)
                ends[:, state] = 0
                nodes = Nodes(part, ends, np.zeros(len(part), dtype=bool))
                ways.append(nodes.cost[nodes.begin])
            costs += list(np.stack(ways, axis=2).reshape(len(part), 16))
        roles = [np.array([c[0] & 3, c[-1] & 3], dtype=np.int32) for c in codes]
        yield pd.DataFrame({"conv": frame.conv, "part": frame.part, "seg": frame.seg, "costs": costs, "roles": roles})


def _costs_after(frame: pd.DataFrame) -> pd.DataFrame:
    """Backwards over a conversation's segments: the costs that follow each."""
    frame = frame.sort_values(["part", "seg"])
    after, ends = FINAL, []
    for costs in reversed(frame.costs.to_list()):
        ends.append(after)
        after = np.minimum((np.asarray(costs).reshape(4, 4) + after[None, :]).min(axis=1), FAR)
    roles = np.stack(frame.roles.to_list())
    border = np.concatenate([[0], _illegal(roles[:-1, 1], roles[1:, 0])])
    last = np.arange(len(frame)) == len(frame) - 1
    return pd.DataFrame({"conv": frame.conv, "part": frame.part, "seg": frame.seg, "ends": ends[::-1], "last": last, "border": border})


def _illegal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    fine = ((before == SYSTEM) | (before == ASSISTANT)) & (after == USER) | (before == USER) & (after == ASSISTANT)
    return (~fine).astype(np.int64)


def _solve(frames):
    """Per segment: the least audit and the state behind it, from the start or (of several segments) from every state."""
    for frame in frames:
        codes = [np.frombuffer(c, dtype=np.uint8) for c in frame.codes]
        alone = frame.ends.isna().to_numpy()
        ends = np.stack([FINAL if e is None else np.asarray(e, dtype=np.int64) for e in frame.ends.where(~alone, None)]) if len(frame) else np.zeros((0, 4))
        last = alone | frame["last"].eq(True).to_numpy()
        audits, exits, costs, illegal = [], [], [], []
        for group in _groups(codes):
            nodes = Nodes(codes[group], ends[group], last[group])
            nodes.rank()
            wanted = np.where(alone[group], 1, 4)
            starts = np.concatenate([4 * b + np.arange(w) for b, w in zip(nodes.begin, wanted)])
            texts, behind = nodes.audits(starts)
            cuts = np.concatenate([[0], np.cumsum(wanted)])
            for a, b in zip(cuts[:-1], cuts[1:]):
                audits.append(texts[a:b])
                exits.append((behind[a:b] % 4).astype(np.int32))
            costs += list(nodes.cost[nodes.begin, START])
            illegal += [int(_illegal(c[:-1] & 3, c[1:] & 3).sum()) for c in codes[group]]
        first = alone | ((frame.part == frame["from"]) & (frame.seg == 0)).to_numpy()
        cost = np.where(first, np.array(costs, dtype=np.int64), 0)
        illegal = np.array(illegal, dtype=np.int64) + frame.border.fillna(0).to_numpy().astype(np.int64)
        yield pd.DataFrame({"conv": frame.conv, "part": frame.part, "seg": frame.seg, "audits": audits, "exits": exits, "cost": cost, "illegal": illegal})


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    """Forwards over a conversation's segments: the state each is entered in."""
    frame = frame.sort_values(["part", "seg"])
    state, states = START, []
    for exits in frame.exits:
        states.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv": frame.conv, "part": frame.part, "seg": frame.seg, "entry": np.array(states, dtype=np.int32)})


def least_audits(segments: DataFrame) -> DataFrame:
    """(conv, part, seg, entry, audit, cost, illegal) for segments (conv, part, seg, codes); ``cost`` stands on the first segment."""
    several = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("_n"), F.min("part").alias("from")).where("_n > 1").select("conv", "from")
    cut = through_table(splittable_join(segments, several, ["conv"], "inner"), "conversation-cut")
    tables = cut.mapInPandas(_transfer, "conv string, part int, seg int, costs array<bigint>, roles array<int>")
    after = tables.groupBy("conv").applyInPandas(_costs_after, "conv string, part int, seg int, ends array<bigint>, last boolean, border bigint")
    place = ["conv", "part", "seg"]
    known = segments.join(after, place, "left").join(cut.select(*place, "from"), place, "left")
    solved = known.mapInPandas(_solve, "conv string, part int, seg int, audits array<string>, exits array<int>, cost bigint, illegal bigint")
    solved = through_table(solved, "conversation-audits")
    entries = solved.where(F.size("exits") > 1).select(*place, "exits").groupBy("conv").applyInPandas(_entries, "conv string, part int, seg int, entry int")
    chosen = solved.join(entries, place, "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    return chosen.select(*place, "entry", F.get("audits", F.col("entry")).alias("audit"), "cost", "illegal")


# --- repaired text ----------------------------------------------------------------------------------


class _Repair:
    """Hash, audit and counts of one conversation, fed segment by segment and turn by turn."""

    def __init__(self, conv: str):
        self.conv, self.hash, self.audit, self.cost, self.illegal = conv, hashlib.sha256(), [], 0, 0
        self.empty, self.edits, self.at, self.place, self.state = True, "", 0, 0, START

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state = int(NEXT[self.state])
            self._say(NAMES[self.state], "")
            self.at += 1

    def _forward(self, place: int | None = None) -> None:
        """Past the turns before ``place`` or all: they are deleted ones, as turns that may stay are fed one by one."""
        while self.at < len(self.edits) and (place is None or self.place < place):
            self._inserts()
            self.at += 1
            self.place += 1
        self._inserts()

    def segment(self, entry: int, audit: str, cost: int, illegal: int) -> None:
        self._forward()
        self.audit.append(audit)
        self.cost += cost
        self.illegal += illegal
        self.edits, self.at, self.place, self.state = audit, 0, 0, entry

    def turn(self, place: int, role: str, text: str) -> None:
        self._forward(place)
        edit = self.edits[self.at]
        self.at += 1
        self.place += 1
        if edit == "K":
            self.state = int(KEEP["sua".index(role[0]), self.state])
            self._say(role, text)
        elif edit == "R":
            self.state = int(NEXT[self.state])
            self._say(NAMES[self.state], text)

    def result(self) -> tuple:
        self._forward()
        return self.conv, self.cost, self.illegal, "".join(self.audit), self.hash.hexdigest()


REPAIRED = "conv string, cost bigint, illegal bigint, audit string, repaired_sha256 string"


def _hash_turns(batches):
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    now = None

    def out(results):
        columns = list(zip(*results)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        done = []
        for conv, place, role, text, entry, audit, cost, illegal in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.result())
                now = _Repair(conv)
            if place < 0:
                now.segment(entry, audit, cost, illegal)
            else:
                now.turn(place, role, text)
        yield out(done)
    if now is not None:
        yield out([now.result()])


def hash_repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """REPAIRED per conversation. Every segment's audit comes before its turns in one sorted stream."""
    place = ["conv", "part", "seg"]
    turns = rows.select(*place, "place", "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in {"entry": "int", "audit": "string", "cost": "bigint", "illegal": "bigint"}.items()])
    heads = audits.select(*place, F.lit(-1).alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "entry", "audit", "cost", "illegal")
    stream = heads.unionByName(turns).repartition("conv").sortWithinPartitions(*place, "place")
    return stream.drop("part", "seg").mapInArrow(_hash_turns, REPAIRED)


def repair(conversations: DataFrame, harm=None, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``harm`` changes the rows of ``keyed`` first, as ``damage`` does; None takes them as they are.
    """
    rows = keyed(conversations)
    all_ids = rows.select("conv", "conv_id").distinct()
    marked = mark_faults(rows.withColumn("copies", F.lit(1).cast("long")).drop("conv_id") if harm is None else harm(rows))
    packed = through_table(pack(marked, segment), "conversation-segments")
    audits = least_audits(packed.where("codes IS NOT NULL").select("conv", "part", "seg", "codes"))
    repaired = hash_repaired(packed.where("text IS NOT NULL"), audits)
    whole = all_ids.join(count_faults(marked), "conv", "left").join(repaired, "conv", "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def query(spark, sf_dir):
    return repair(read_table(spark, sf_dir, "conversations"), damage)
