"""The trie of conversation prefixes, from sorted conversations and their LCPs.

A conversation is the row of 128-bit digests of its turns (role and text). Rows
sorted by these have the members of every prefix next to each other, and the
longest common prefix (LCP) of neighbours says where prefixes begin and end: a
prefix of depth d at row i reaches left and right as long as the LCPs stay at d
or above. A sparse table of range minima answers each of these two questions by
a binary search of its own, for all candidate prefixes at once and without a
stack. What a prefix is worth (members, smallest member, children, leaves,
saved tokens) then comes from prefix sums and range minima over its extent.

Distribution. The rows are sorted by range on (digests, conv_id) into parts of
about `TURNS_A_PART` turns; parts have numbers, and a second sparse table goes
over the parts (the smallest LCP in each and at its border). A prefix inside a
part is done there. One that crosses borders is known by the part where it
begins and its depth: each part states its piece of it, found by a binary
search over parts, pieces are summed up, and the sums go back to the parts that
have such a piece, which need them to name parents. So a first turn shared by
all conversations costs one piece per part. Texts stay where they are; a
conversation is one row of 20 bytes a turn, and the driver holds four numbers
per part.

Members whose last turn is the prefix are equal rows in a run. Their ids are
hashed in the part; those of a run over several parts are joined to one text
per part and hashed in order, one part's text at a time.

Defined cases: rows with a null conv_id belong to no conversation; a null role
or text is empty; turns come by number, null first, and turns of one number by
the digest of role and text; repeated rows are turns of their own; other
columns are ignored; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import prepare, record, saved

TURN_BYTES = 16
TURNS_A_PART = 25_000
ROWS_OUT = 20_000


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, digests (16 bytes a turn in order) and chars (code points of each turn's text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).alias("chars")
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every, h = crc32(c) % most."""
    own = sequences(conversations)
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).join(heads, "head", "left").withColumn("h", h)
    first = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rows = rows.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))
    return packed(rows)


def packed(rows: DataFrame) -> DataFrame:
    """conv_id, digests, chars of rows conv_id and turns."""
    digests = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return rows.select("conv_id", digests.alias("digests"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two rows of digests begin with in common."""
    low, high = 0, min(len(a), len(b)) // TURN_BYTES
    if a[: high * TURN_BYTES] == b[: high * TURN_BYTES]:
        return high
    high -= 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * TURN_BYTES] == b[: mid * TURN_BYTES]:
            low = mid
        else:
            high = mid - 1
    return low


def _with_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, row and the LCP with the row before in the part (-1 in front)."""
    part, row, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column("digests").to_pylist()
        lcp = []
        for key in keys:
            lcp.append(-1 if last is None else shared_turns(last, key))
            last = key
        n = len(keys)
        columns = [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(row, row + n), pa.int64()), pa.array(lcp, pa.int32())]
        row += n
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "row", "lcp"])


class SparseTable:
    """Minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[: len(below) - step], below[step:]))
            step *= 2

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last r for which all values behind `at` up to r are at least `depth`."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            inside = at + 1 < len(level)
            go = inside & (level[np.where(inside, at + 1, 0)] >= depth)
            at[go] += 1 << k
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first l for which all values behind l up to `at` are at least `depth`; -1 if the first value is, too."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            inside = start >= 0
            go = inside & (self.levels[k][np.where(inside, start, 0)] >= depth)
            at[go] -= 1 << k
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of the ranges first to last, both included."""
        k = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k):
            on = k == level
            table = self.levels[level]
            out[on] = np.minimum(table[first[on]], table[last[on] - (1 << int(level)) + 1])
        return out


class Parts:
    """What all tasks know of all parts: the LCP over the border in front of each,
    the smallest inside, and whether its first row repeats the row before."""

    def __init__(self, border: dict[int, int], inner: dict[int, int | None], repeats: dict[int, bool], all_equal: dict[int, bool]):
        self.numbers = sorted(inner)
        self.place = {p: i for i, p in enumerate(self.numbers)}
        self.border = np.array([border.get(p, -1) for p in self.numbers] + [-1], np.int64)
        self.inner = np.array([1 << 40 if inner[p] is None else inner[p] for p in self.numbers], np.int64)
        self.repeats = [repeats.get(p, False) for p in self.numbers] + [False]
        self._through = SparseTable(np.minimum(self.inner, self.border[:-1]))
        # Where the run begins that goes on into a part.
        self.run_owner = [0] * (len(self.numbers) + 1)
        for i in range(1, len(self.numbers)):
            goes_on = self.repeats[i - 1] and all_equal[self.numbers[i - 1]]
            self.run_owner[i] = self.run_owner[i - 1] if goes_on else i - 1

    def owners(self, part: int, depths: np.ndarray) -> np.ndarray:
        """The part where the prefix of each depth begins that reaches over the border in front of `part`."""
        return self._through.left(np.full(len(depths), part - 1, np.int64), depths)


class Piece:
    """All prefixes that a part has a piece of, with what the piece adds up to."""

    def __init__(self, part: int, parts: Parts, conv: np.ndarray, lcp: np.ndarray, chars: np.ndarray, ends: np.ndarray):
        n = len(conv)
        self.n, self.conv = n, conv
        length = np.diff(ends)
        lcps = np.append(lcp, parts.border[part + 1]).astype(np.int64)
        lcps[0] = parts.border[part]
        self.length = length
        table, smallest = SparseTable(lcps), SparseTable(conv)
        # Candidates: depths of a row that the row before does not share, and those that come over the border.
        new = length - lcps[:-1]
        at = np.repeat(np.arange(n), new)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(new) - new, new) + lcps[at] + 1
        over = np.arange(lcps[0] + 1)
        self.at = np.concatenate([np.zeros(len(over), np.int64), at])
        self.depth = np.concatenate([over, depth])
        self.begun_before = np.arange(len(self.at)) < len(over)
        self.last = np.minimum(table.right(self.at, self.depth), n - 1)
        self.goes_on = (self.last == n - 1) & (lcps[n] >= self.depth)
        # The parent is the prefix one shorter, with extents of its own.
        up = self.depth - 1
        self.parent_first = np.maximum(table.left(self.at, up), 0)
        self.parent_last = np.minimum(table.right(self.at, up), n - 1)
        self.parent_before = lcps[0] >= up
        self.parent_before &= self.parent_first == 0
        self.parent_open = self.parent_before | ((self.parent_last == n - 1) & (lcps[n] >= up))
        self.parent_conv = smallest.least(self.parent_first, self.parent_last)
        # Sums over rows of the piece.
        total = lambda values: np.concatenate([[0], np.cumsum(values)])
        spent = total(chars)
        upto = lambda row, d: spent[ends[row] + np.maximum(d, 0)] - spent[ends[row]]
        rows = np.arange(n)
        whole = upto(rows, length)
        fresh = whole - upto(rows, lcps[:-1])
        all_of, fresh_of = total(whole), total(fresh)
        leaf_of = total(lcps[1:] < length)
        first, after = self.at, self.last + 1
        self.convs = after - first
        self.least = smallest.least(first, self.last)
        self.leaves = leaf_of[after] - leaf_of[first]
        before = upto(first, up)
        own = np.where(self.begun_before, fresh[first], whole[first] - before)
        self.saved = all_of[after] - all_of[first] - self.convs * before - (fresh_of[after] - fresh_of[first + 1]) - own
        branching = np.flatnonzero(length > lcps[:-1])
        keys = np.sort(lcps[branching] * (n + 1) + branching)
        count = lambda upper: np.searchsorted(keys, self.depth * (n + 1) + upper, "left")
        own_child = np.where(self.begun_before, (lcps[first] == self.depth) & (length[first] > self.depth), length[first] > self.depth)
        self.children = count(after) - count(first + 1) + own_child
        # Runs of equal rows.
        equal = lcps[:-1] == length
        heads = np.flatnonzero(~equal)
        self.run_end = np.full(n + 1, n, np.int64)
        self.run_end[heads] = np.append(heads[1:], n)
        self.first_run_end = int(heads[0]) if len(heads) else n
        self.last_head = int(heads[-1]) if len(heads) else 0

    def ids(self, first: int, last: int) -> str:
        return ",".join(map(str, self.conv[first:last].tolist()))


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one part after the other, from rows sorted by part."""
    held: list[pa.RecordBatch] = []
    number = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if number is not None and own[a] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(own[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield number, pa.Table.from_batches(held)


def _piece(number: int, rows: pa.Table, parts: Parts) -> tuple[int, Piece]:
    place = parts.place[number]
    chars = rows.column("chars").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(chars.value_lengths().to_numpy())]).astype(np.int64)
    values = chars.flatten().to_numpy().astype(np.int64)
    conv, lcp = rows.column("conv_id").to_numpy().astype(np.int64), rows.column("lcp").to_numpy().astype(np.int64)
    return place, Piece(place, parts, conv, lcp, values, ends)


OPEN = pa.schema(
    [("owner", pa.int32()), ("depth", pa.int32()), ("part", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64())]
    + [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ids", pa.string())]
)
OPEN_DDL = "owner int, depth int, part int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ids string"
NODES = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64())]
    + [("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
)
NODES_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RUN = -1  # stands for a depth in rows about a run of equal conversations


def _open_pieces(parts: Parts):
    """Pieces of prefixes that cross borders, and the ids of runs that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _part_rows(batches):
            place, piece = _piece(number, rows, parts)
            on = np.flatnonzero(piece.begun_before | piece.goes_on)
            before = piece.begun_before[on]
            owner = np.full(len(on), place, np.int64)
            owner[before] = parts.owners(place, piece.depth[on][before])
            values = [piece.least[on], piece.convs[on], piece.children[on], piece.leaves[on], piece.saved[on], [None] * len(on)]
            yield record(OPEN, owner, piece.depth[on], np.full(len(on), place), *values)
            texts = []
            if parts.repeats[place]:
                texts.append((parts.run_owner[place], piece.ids(0, piece.first_run_end)))
            if parts.repeats[place + 1] and piece.first_run_end < piece.n:
                texts.append((place, piece.ids(piece.last_head, piece.n)))
            for run_owner, text in texts:
                yield record(OPEN, [run_owner], [RUN], [place], [None], [None], [None], [None], [None], [text])

    return run


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each owner in order."""
    owner, state, out = None, None, []
    for batch in batches:
        for own, text in zip(batch.column("owner").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own != owner:
                if owner is not None:
                    out.append((owner, state.hexdigest()))
                owner, state = own, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if owner is not None:
        out.append((owner, state.hexdigest()))
    schema = pa.schema([("owner", pa.int32()), ("ids", pa.string())])
    yield record(schema, [x[0] for x in out], [x[1] for x in out])


NO_IDS = hashlib.sha256(b"").hexdigest()


def _all_nodes(parts: Parts):
    """The prefixes that begin in a part, from its rows and the sums of those that cross its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _part_rows(batches):
            about = table.column("about").to_numpy()
            place, piece = _piece(number, table.filter(pa.array(about == 1)), parts)
            sums = table.filter(pa.array(about == 0)).select(["owner", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ids"]).to_pylist()
            known = {(r["owner"] == place, r["depth"]): r for r in sums}
            begins = np.flatnonzero(~piece.begun_before)
            goes_on, depth, at = piece.goes_on, piece.depth, piece.at
            numbers = {"conv_id": piece.least, "n_convs": piece.convs, "n_children": piece.children, "n_leaves": piece.leaves, "saved_tokens": piece.saved}
            for i in begins[goes_on[begins]].tolist():
                for name, values in numbers.items():
                    values[i] = known[True, int(depth[i])][name]
            parent = piece.parent_conv
            for i in begins[piece.parent_open[begins] & (depth[begins] > 0)].tolist():
                parent[i] = known[not piece.parent_before[i], int(depth[i]) - 1]["conv_id"]
            ends = []
            for i in begins.tolist():
                row = int(at[i])
                if depth[i] != piece.length[row]:
                    ends.append(NO_IDS)
                elif piece.run_end[row] == piece.n and parts.repeats[place + 1]:
                    ends.append(known[True, RUN]["ids"])
                else:
                    ends.append(hashlib.sha256(piece.ids(row, int(piece.run_end[row])).encode()).hexdigest())
            parents = pa.array(parent[begins], pa.int64(), mask=depth[begins] == 0)
            columns = [piece.least[begins], depth[begins], parents, *[numbers[c][begins] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns] + [pa.array(ends, pa.string())]
            whole = pa.RecordBatch.from_arrays(arrays, schema=NODES)
            for a in range(0, whole.num_rows, ROWS_OUT):
                yield whole.slice(a, ROWS_OUT)

    return run


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("border", pa.int32()), ("repeats", pa.bool_())])
    for batch in batches:
        pairs = list(zip(batch.column("last").to_pylist(), batch.column("first").to_pylist(), strict=True))
        yield record(schema, batch.column("next"), [shared_turns(a, b) for a, b in pairs], [a == b for a, b in pairs])


def nodes(rows: DataFrame, turns_a_part: int = TURNS_A_PART) -> DataFrame:
    """All prefixes of the rows (conv_id, digests, chars) with their numbers."""
    spark = prepare(rows.sparkSession)
    rows = saved(rows, "trie-rows")
    size = rows.agg(F.sum(F.size("chars") + 1)).first()[0]
    if not size:
        return spark.createDataFrame([], NODES_DDL)
    ranged = rows.repartitionByRange(max(1, -(-size // turns_a_part)), "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    shape = "conv_id long, digests binary, chars array<int>, part int, row long, lcp int"
    rows = saved(ranged.mapInArrow(_with_lcp, shape), "trie-sorted")
    inside = F.when(F.col("row") > 0, F.col("lcp"))
    equal = F.coalesce(F.min(F.when(F.col("row") > 0, F.col("lcp") * TURN_BYTES == F.octet_length("digests"))), F.lit(True))
    edges = rows.groupBy("part").agg(F.min("digests").alias("first"), F.max("digests").alias("last"), F.min(inside).alias("inner"), equal.alias("equal"))
    edges = saved(edges, "trie-edges")
    about = {r.part: r for r in edges.select("part", "inner", "equal").collect()}
    numbers = sorted(about)
    follow = spark.createDataFrame(list(zip(numbers, numbers[1:], strict=False)), "part int, next int")
    pairs = edges.select("part", "last").join(follow, "part").join(edges.select(F.col("part").alias("next"), "first"), "next")
    borders = {r.part: r for r in pairs.mapInArrow(_border, "part int, border int, repeats boolean").collect()}
    parts = Parts(
        {p: r.border for p, r in borders.items()}, {p: r.inner for p, r in about.items()},
        {p: r.repeats for p, r in borders.items()}, {p: r.equal for p, r in about.items()},
    )
    sent = spark.sparkContext.broadcast(parts)
    own = rows.select("part", F.lit(1).alias("about"), "row", "conv_id", "chars", "lcp")
    dealt = own.repartition("part").sortWithinPartitions("part", "row")
    pieces = saved(dealt.mapInArrow(lambda batches: _open_pieces(sent.value)(batches), OPEN_DDL), "trie-pieces")
    crossing = pieces.where(F.col("depth") != RUN)
    sums = crossing.groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    runs = pieces.where(F.col("depth") == RUN).select("owner", "part", "ids").repartition("owner").sortWithinPartitions("owner", "part")
    hashed = runs.mapInArrow(_hash_runs, "owner int, ids string").withColumn("depth", F.lit(RUN)).withColumn("part", F.col("owner"))
    back = crossing.select("owner", "depth", "part").join(sums, ["owner", "depth"]).unionByName(hashed, allowMissingColumns=True)
    place = spark.createDataFrame(list(enumerate(numbers)), "part int, number int")
    back = back.join(place, "part").drop("part").withColumnRenamed("number", "part").withColumn("about", F.lit(0))
    both = own.unionByName(back, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "about", "row")
    return both.mapInArrow(lambda batches: _all_nodes(sent.value)(batches), NODES_DDL)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    prepare(conversations.sparkSession)
    return nodes(rebuilt(conversations))
