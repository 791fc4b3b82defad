"""Structure repair of conversations: cost DP, then prefix-doubling ranks of the optimal paths.

Roles must read `(s?(ua)+)?`. A row is kept, given the role that is due, or
deleted; empty turns of the role that is due may be put in anywhere. Places are
(row, state); the state says what has been emitted last. In a piece of at most
PIECE rows the DP gives the cost from every place to each of the four states in
which the piece's last row may be left. Each place keeps the arcs of least
cost; doubled pointers jump 1, 2, 4, ... edits ahead, and places are ranked by
so many letters of their audit: rank of the first half, then rank of the place
half way. The ranks say which of two equally cheap ways out of a piece reads
less; no way is a prefix of another one, because each ends with the last row.

A piece is thus a 4 x 4 table of costs and ranks. Tables of a conversation are
chained in one task (a row for up to PIECE turns), the chosen ends go back to
the pieces, and doubled pointers spell out each piece's audit. Texts are shuffled
once, to their piece; those of a conversation of several pieces once more, as rendered text.

Rows are sorted by turn, so slices of SLICE turn numbers are the tasks' groups
and rows of one slice are streamed. A row that repeats an earlier one of another
slice is known by a marker from an aggregate over digests.

Defined results: rows with NULL conv_id belong to no conversation. NULL role or
text is one space, so the row is blank. NULL turns come first; rows of a turn
are ordered by a digest of role and text after the damage. Repeated rows are
duplicates. An empty table has no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import small_batches
from .rows import written

SLICE_BITS = 9
PIECE = 1024
INSERT = REROLE = UNFINISHED = 3
DELETE = 4
_FIRST = -(1 << 63)
_FAR = np.int64(1) << 40
# States: nothing yet, after system, after user, after assistant. The role due after each, and the state it leads to.
_DUE = np.array([2, 2, 3, 2])
_NAMES = {2: "user", 3: "assistant"}
_LETTERS = np.frombuffer(b"DIKR", np.uint8)
# At the end of a conversation: what is still to be put in, by state.
_TAIL = ((), (2, 3), (3,), ())
_WORDLESS = r"^[\x20\x09-\x0D]*\z"
_UNFINISHED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that the checksum of `conv_id:turn` names: dropped, emptied, unpunctuated, repeated or given to the user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return (rows.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_"))


def _placed(rows: DataFrame) -> DataFrame:
    """`conv_id`, `part` (slice of turns), `o`, `digest` and what the repair must know of a row."""
    o = F.coalesce("turn", F.lit(_FIRST))
    initial = F.substring("role", 1, 1)
    state = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).cast("int")
    return rows.select("conv_id", F.shiftright(o, SLICE_BITS).alias("part"), o.alias("o"),
                       F.md5(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8")).alias("digest"), F.lit(1).alias("mark"),
                       F.col("text").rlike(_WORDLESS).alias("blank"), F.col("text").rlike(_UNFINISHED).alias("truncated"), state.alias("state"), "role", "text")


def _repeats(thin: DataFrame) -> DataFrame:
    """(conv_id, o, digest) of rows whose content stands on an earlier turn: one per place, in front of its rows."""
    places = thin.groupBy("conv_id", "digest", "o").agg(F.count(F.lit(1)).alias("c"))
    first = places.groupBy("conv_id", "digest").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return places.join(first, ["conv_id", "digest"]).where("o > first").select("conv_id", F.shiftright("o", SLICE_BITS).alias("part"), "o", "digest")


def _grouped(thin: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and markers of each slice side by side and in order; markers stand in front of their rows."""
    extra = {c: F.lit(None).cast(thin.schema[c].dataType) for c in columns if c not in marks.columns}
    both = thin.select(columns).union(marks.withColumns(extra).withColumn("mark", F.coalesce("mark", F.lit(0))).select(columns))
    return both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "o", "digest", "mark")


class Pieces:
    """Consecutive rows of conversations, cut into pieces; all arrays run over rows."""

    def __init__(self, starts: np.ndarray, state: np.ndarray, must: np.ndarray, open_end: np.ndarray):
        self.starts, self.n = starts[:-1], np.diff(starts)
        self.state, self.must, self.open_end = state, must, open_end

    def graph(self, which: np.ndarray, exits: np.ndarray):
        """Cost, letter and next place of every place of pieces `which`, for ways that leave by `exits` (one column each).

        Places are numbered by (piece, row, state, exit); row n holds the exits themselves.
        """
        n, k, e = self.n[which], len(which), exits.shape[1]
        longest = int(n.max())
        cost = np.full((longest + 1, k, 4, e), _FAR)
        letter = np.full((longest + 1, k, 4, e), -1, np.int8)
        to = np.broadcast_to(np.arange(4, dtype=np.int64)[None, None, :, None], cost.shape).copy()  # state of the next place
        ahead = np.zeros(cost.shape, np.int64)  # rows to the next place
        at_exit = np.arange(4)[None, :, None] == exits[:, None, :]
        for i in range(longest, -1, -1):
            ends, runs = n == i, n > i
            cost[i][ends] = np.where(at_exit[ends], 0, _FAR)
            if not runs.any():
                continue
            row = self.starts[which[runs]] + i
            state, must, late = self.state[row], self.must[row], np.where(self.open_end[row], UNFINISHED, 0)[:, None, None]
            after = cost[i + 1][runs]
            due = after[:, _DUE]
            # From nothing a kept system row leads to its state; a kept row else must be the one that is due.
            fits = (state[:, None] == _DUE) | ((state[:, None] == 1) & (np.arange(4) == 0))
            kept_to = np.where((state[:, None] == 1) & (np.arange(4) == 0), 1, _DUE)
            keep = np.where((fits & ~must[:, None])[:, :, None], np.take_along_axis(after, kept_to[:, :, None].repeat(e, 2), 1) + late, _FAR)
            rerole = np.where(must[:, None, None], _FAR, due + REROLE + late)
            delete = after + DELETE
            best = np.minimum(np.minimum(keep, rerole), delete)
            # Puts lead to user, then to assistant, then to user: two steps close the circle, two more reach it.
            for _ in range(3):
                best = np.minimum(best, best[:, _DUE] + INSERT)
            insert = best[:, _DUE] + INSERT
            options = np.stack([delete, insert, keep, rerole])
            pick = (options == best[None]).argmax(0)
            cost[i][runs], letter[i][runs] = np.minimum(best, _FAR), np.where(best < _FAR, pick, -1)
            step = np.where(pick == 0, np.arange(4)[None, :, None], np.where(pick == 2, kept_to[:, :, None], _DUE[None, :, None]))
            to[i][runs] = np.where(best < _FAR, step, to[i][runs])
            ahead[i][runs] = (best < _FAR) & (pick != 1)
        return cost, letter, to, ahead

    @staticmethod
    def pointers(letter, to, ahead):
        rows, k, _, e = letter.shape
        r, p, _, x = np.indices(letter.shape, sparse=True)
        return ((((r + ahead) * k + p) * 4 + to) * e + x).ravel()

    def tables(self, which: np.ndarray):
        """Costs and ranks of the ways from each state before a piece to each exit: two arrays (piece, state, exit)."""
        cost, letter, to, ahead = self.graph(which, np.broadcast_to(np.arange(4), (len(which), 4)))
        jump, rank = self.pointers(letter, to, ahead), letter.ravel().astype(np.int64) + 1
        while True:
            # Ranks by twice as many letters: of the first half, then of the place half way.
            pair = rank * (int(rank.max()) + 1) + rank[jump]
            _, rank = np.unique(pair, return_inverse=True)
            further = jump[jump]
            if (further == jump).all():
                return cost[0], rank.reshape(letter.shape)[0]
            jump = further

    def audits(self, which: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> list[np.ndarray]:
        """Places along the least way of each piece: arrays of (row, state, letter), spelled by doubled pointers."""
        _, letter, to, ahead = self.graph(which, leave[:, None])
        jump, flat, k = self.pointers(letter, to, ahead), letter.ravel(), len(which)
        path = (np.arange(k) * 4 + enter)[:, None]
        while (flat[path[:, -1]] >= 0).any():
            path = np.concatenate([path, jump[path]], axis=1)
            jump = jump[jump]
        return [np.stack([p // (k * 4), p % 4, flat[p]], 1)[flat[p] >= 0] for p in path]


def _buckets(n: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of like length together, so that padding at most doubles the work; so many that their tables stay small."""
    size = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for s in np.unique(size):
        found = np.flatnonzero(size == s)
        step = max(1, (1 << 15) >> s)
        for i in range(0, len(found), step):
            yield found[i:i + step]


class Span:
    """Consecutive rows and markers, cut between slices of turns or, inside a long one, between pieces."""

    def __init__(self, table: pa.Table, offset: int, previous: tuple | None):
        self.table = table
        conv, part, o, mark = (table.column(c).to_numpy() for c in ("conv_id", "part", "o", "mark"))
        n = len(conv)
        same = np.zeros(n, bool)
        if n > 1:
            digest = table.column("digest")
            equal = pc.equal(digest.slice(1), digest.slice(0, n - 1)).to_numpy()
            same[1:] = (conv[1:] == conv[:-1]) & (part[1:] == part[:-1]) & (o[1:] == o[:-1]) & equal
        goes_on = previous is not None and previous[:2] == (conv[0], part[0])
        if goes_on:
            same[0] = previous[2:] == (o[0], table.column("digest")[0].as_py())
        self.real = np.flatnonzero(mark == 1)
        self.seen = same[self.real]
        self.rows = table.take(pa.array(self.real))
        self.conv, self.part, self.o = conv[self.real], part[self.real], o[self.real]
        if not len(self.real):
            return
        change = np.r_[True, (self.conv[1:] != self.conv[:-1]) | (self.part[1:] != self.part[:-1])]
        first = np.flatnonzero(change)
        group = np.cumsum(change) - 1
        place = np.arange(len(self.real)) - first[group]
        goes_on = goes_on and previous[:2] == (self.conv[0], self.part[0])
        place[group == 0] += offset if goes_on else 0
        self.at = np.flatnonzero((place % PIECE == 0) | change)
        self.starts = np.append(self.at, len(self.real))
        self.number = place[self.at] // PIECE
        # Rows on a turn of their own conversation that no row before them is on.
        self.fresh = np.r_[not (goes_on and previous[2] == self.o[0]), (self.o[1:] != self.o[:-1]) | (self.conv[1:] != self.conv[:-1])]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[Span]:
    held: list[pa.Table] = []
    size, offset, previous = 0, 0, None

    def span(table: pa.Table) -> Span:
        nonlocal offset, previous
        made = Span(table, offset, previous)
        last = table.slice(table.num_rows - 1).to_pylist()[0]
        group = (last["conv_id"], last["part"])
        inside = int(((made.conv == group[0]) & (made.part == group[1])).sum())
        offset = inside + (offset if previous is not None and previous[:2] == group else 0)
        previous = (*group, last["o"], last["digest"])
        return made

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < 4 * PIECE:
            continue
        table = pa.concat_tables(held)
        conv, part = table.column("conv_id").to_numpy(), table.column("part").to_numpy()
        border = np.flatnonzero((conv[1:] != conv[:-1]) | (part[1:] != part[:-1])) + 1
        cut = int(border[-1]) if len(border) else 0
        if not cut:
            # One slice only: cut after a whole number of its pieces.
            done = offset if previous is not None and previous[:2] == (conv[0], part[0]) else 0
            count = done + np.cumsum(table.column("mark").to_numpy() == 1)
            whole = np.flatnonzero((count % PIECE == 0) & (table.column("mark").to_numpy() == 1)) + 1
            cut = int(whole[-1]) if len(whole) else 0
        if cut:
            yield span(table.slice(0, cut))
        held = [table.slice(cut)]
        size = held[0].num_rows
    table = pa.concat_tables(held) if held else None
    if table is not None and table.num_rows:
        yield span(table)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece: its tables and its counts."""
    for span in _spans(batches):
        if not len(span.real):
            continue
        state, blank, late = (span.rows.column(c).to_numpy() for c in ("state", "blank", "truncated"))
        seen = span.seen & ~blank
        late = late & ~blank & ~seen
        made, at, conv, o = Pieces(span.starts, state, blank | seen, late), span.at, span.conv, span.o
        cost, rank = np.empty((len(at), 4, 4), np.int64), np.empty((len(at), 4, 4), np.int64)
        for which in _buckets(made.n):
            cost[which], rank[which] = made.tables(which)
        wrong = np.zeros(len(o), bool)
        wrong[1:] = ~_legal(state[:-1], state[1:])
        wrong[at] = False  # between pieces: counted where they are chained
        known = o != _FIRST
        total = lambda x: np.add.reduceat(x.astype(np.int64), at)
        square = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 16).cast(pa.list_(pa.int64()))
        none = total(known) == 0
        low = np.minimum.reduceat(np.where(known, o, np.iinfo(np.int64).max), at)
        yield pa.RecordBatch.from_pydict({
            "conv_id": conv[at], "part": span.part[at], "piece": span.number, "cost": square(cost), "rank": square(rank), "blank": total(blank),
            "duplicate": total(seen), "truncated": total(late), "illegal": total(wrong), "head": state[at], "tail": state[span.starts[1:] - 1],
            "turns": total(span.fresh & known), "low": pa.array(low, mask=none), "high": pa.array(np.maximum.reduceat(o, at), mask=none)})


_SUMMARY = ("conv_id long, part long, piece long, cost array<long>, rank array<long>, blank long, duplicate long, truncated long, illegal long, "
            "head int, tail int, turns long, low long, high long")


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))


def _chain(conv: np.ndarray, cost: np.ndarray, rank: np.ndarray):
    """States before and after each piece on the cheapest, then least way, and each conversation's cost; rows are ordered."""
    k = len(conv)
    enter, leave, after = np.zeros(k, np.int64), np.zeros(k, np.int64), np.empty((k, 4), np.int64)
    last = np.r_[conv[1:] != conv[:-1], True]
    end = np.array([INSERT * len(t) for t in _TAIL])
    after[:] = end
    first = np.r_[True, last[:-1]]
    for i in np.flatnonzero(~last)[::-1]:  # only conversations of several pieces
        after[i] = (cost[i + 1] + after[i + 1][None]).min(1)
    whole = cost + after[:, None, :]
    best = whole.min(2, keepdims=True)
    pick = np.where(whole == best, rank, np.iinfo(np.int64).max).argmin(2)
    leave[first] = pick[first, 0]
    for i in np.flatnonzero(~first):
        enter[i] = leave[i - 1]
        leave[i] = pick[i, enter[i]]
    return enter, leave, best[:, 0, 0], first, last


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen states of every piece; the first piece of a conversation carries its counts."""
    def done(table: pa.Table) -> pa.RecordBatch:
        get = lambda c: table.column(c).to_numpy()
        conv, k = get("conv_id"), table.num_rows
        square = lambda c: np.concatenate([a.flatten().to_numpy() for a in table.column(c).chunks]).reshape(k, 4, 4)
        enter, leave, total, first, last = _chain(conv, square("cost"), square("rank"))
        at = np.flatnonzero(first)
        illegal = get("illegal") + np.r_[False, ~first[1:] & ~_legal(get("tail")[:-1], get("head")[1:])]
        add = lambda x: np.where(first, np.add.reduceat(x, at)[np.cumsum(first) - 1], 0)
        known = ~table.column("low").is_null().to_numpy()
        low, high = (table.column(c).fill_null(0).to_numpy() for c in ("low", "high"))
        lo = np.minimum.reduceat(np.where(known, low, np.iinfo(np.int64).max), at)[np.cumsum(first) - 1]
        hi = np.maximum.reduceat(np.where(known, high, _FIRST), at)[np.cumsum(first) - 1]
        turns = add(get("turns"))
        pieces = np.diff(np.append(at, k))[np.cumsum(first) - 1]
        return pa.RecordBatch.from_pydict({
            "conv_id": conv, "part": get("part"), "piece": get("piece"), "enter": enter, "leave": leave, "first": first, "last": last, "pieces": pieces,
            "gaps": np.where(turns > 0, hi - lo + 1 - turns, 0), "blank": add(get("blank")), "duplicate": add(get("duplicate")),
            "truncated": add(get("truncated")), "illegal": add(illegal), "cost": np.where(first, total, 0)})

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        conv = table.column("conv_id").to_numpy()
        border = np.flatnonzero(conv[1:] != conv[:-1]) + 1
        cut = int(border[-1]) if len(border) else 0
        if cut:
            yield done(table.slice(0, cut))
        held = [table.slice(cut)]
    if held:
        yield done(held[0])


_CHOICE = ("conv_id long, part long, piece long, enter long, leave long, first boolean, last boolean, pieces long, gaps long, blank long, duplicate long, "
           "truncated long, illegal long, cost long")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired text of each piece; the text of a piece that is a whole conversation only as its hash."""
    chosen: dict[tuple, dict] = {}
    for span in _spans(batches):
        ends = span.table.filter(pc.equal(span.table.column("mark"), 2)).select(["conv_id", "part", "piece", "ends"]).to_pylist()
        last = span.table.slice(span.table.num_rows - 1).select(["conv_id", "part"]).to_pylist()[0]
        chosen.update({(e["conv_id"], e["part"], e["piece"]): e["ends"] for e in ends})
        if not len(span.real):
            continue
        rows, at, number = span.rows, span.at, span.number
        blank, late = rows.column("blank").to_numpy(), rows.column("truncated").to_numpy()
        made = Pieces(span.starts, rows.column("state").to_numpy(), blank | span.seen, late & ~blank & ~span.seen)
        conv, part = span.conv[at], span.part[at]
        want = [chosen[key] for key in zip(conv.tolist(), part.tolist(), number.tolist())]
        chosen = {k: v for k, v in chosen.items() if k[:2] == (last["conv_id"], last["part"])}  # a slice may go on in the next span
        enter, leave = np.array([w["enter"] for w in want]), np.array([w["leave"] for w in want])
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        out: list[tuple] = [()] * len(at)
        for which in _buckets(made.n):
            for piece, path in zip(which, made.audits(which, enter[which], leave[which])):
                lines = []
                for row, state, letter in path.tolist():
                    if letter == 1:
                        lines.append(f"{_NAMES[_DUE[state]]}:")
                    elif letter >= 2:
                        row += at[piece]
                        lines.append(f"{roles[row] if letter == 2 else _NAMES[_DUE[state]]}:{texts[row]}")
                audit = _LETTERS[path[:, 2]].tobytes().decode()
                if want[piece]["last"]:
                    tail = _TAIL[leave[piece]]
                    lines += [f"{_NAMES[t]}:" for t in tail]
                    audit += "I" * len(tail)
                text, alone = "\n".join(lines), want[piece]["pieces"] == 1
                out[piece] = (audit, None if alone else text, len(lines), hashlib.sha256(text.encode()).hexdigest() if alone else None)
        audit, text, lines, sha = zip(*out)
        yield pa.RecordBatch.from_pydict({"conv_id": conv, "part": part, "piece": number, "audit": pa.array(audit), "repaired": pa.array(text, pa.string()),
                                          "lines": pa.array(lines, pa.int64()), "repaired_sha256": pa.array(sha, pa.string())})


_RENDERED = "conv_id long, part long, piece long, audit string, repaired string, lines long, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and hashes of conversations of several pieces; one piece's text is held at a time."""
    at, audit, state, any_line = None, [], None, False

    def row():
        return pa.RecordBatch.from_pydict({"conv_id": [at], "audit": ["".join(audit)], "repaired_sha256": [state.hexdigest()]})

    for batch in batches:
        for i in range(batch.num_rows):
            conv, part, text, lines = (batch.column(c)[i].as_py() for c in ("conv_id", "audit", "repaired", "lines"))
            if conv != at:
                if at is not None:
                    yield row()
                at, audit, state, any_line = conv, [], hashlib.sha256(), False
            audit.append(part)
            if lines:
                state.update(("\n" if any_line else "").encode() + text.encode())
                any_line = True
    if at is not None:
        yield row()


def chosen_ends(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed rows, markers of repeats, and the states before and after each piece with the conversations' counts."""
    placed = _placed(rows)
    thin = placed.drop("role", "text")
    marks = _repeats(thin).withColumn("mark", F.lit(0))
    columns = ["conv_id", "part", "o", "digest", "mark", "blank", "truncated", "state"]
    tables = _grouped(thin, marks, columns).mapInArrow(_summaries, _SUMMARY)
    ordered = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return placed, marks, ordered.mapInArrow(_choices, _CHOICE)


def repair(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of the repaired text for each conversation of `rows` (conv_id, turn, role, text)."""
    small_batches(rows.sparkSession)
    placed, marks, choices = chosen_ends(rows)
    choices = written(choices, "repair-choices")
    ends = choices.select("conv_id", "part", F.lit(_FIRST).alias("o"), F.lit("").alias("digest"), F.lit(2).alias("mark"), "piece",
                          F.struct("enter", "leave", "last", "pieces").alias("ends"))
    columns = ["conv_id", "part", "o", "digest", "mark", "blank", "truncated", "state", "role", "text", "piece", "ends"]
    kind = ends.schema["ends"].dataType
    full = placed.withColumns({"piece": F.lit(None).cast("long"), "ends": F.lit(None).cast(kind)})
    both = marks.withColumns({"piece": F.lit(None).cast("long"), "ends": F.lit(None).cast(kind)}).unionByName(ends)
    pieces = written(_grouped(full, both, columns).mapInArrow(_rendered, _RENDERED), "repair-pieces")
    alone = pieces.where("repaired_sha256 is not null").select("conv_id", "audit", "repaired_sha256")
    several = (pieces.where("repaired_sha256 is null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
               .mapInArrow(_joined, "conv_id long, audit string, repaired_sha256 string"))
    counts = choices.where("first").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return counts.join(alone.union(several), "conv_id")


def structure_repair(conversations: DataFrame) -> DataFrame:
    """`repair` of the damaged rows, with a row for every conversation that was there before."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    return ids.join(repair(damaged(conversations)), "conv_id", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
