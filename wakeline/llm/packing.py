"""Best-fit packing by a configuration linear program over the length histogram.

1. Each document becomes token ids and an end id; a longer one is cut so that only
   its first piece may be shorter than a sequence.
2. Lengths are counted. The histogram has at most ``capacity`` rows whatever the
   corpus holds, and only it reaches the driver.
3. The covering program (fewest sequences, each a multiset of lengths that fits)
   is solved by multiplicative weights: prices on lengths, a knapsack by dynamic
   programming for the configuration of greatest price, prices lowered where the
   chosen configurations cover.
4. The solution is rounded down, and what is left is packed by best fit, longest
   first, over counts of lengths.
5. Pieces get a rank within their length from counts by bucket, and find sequence
   and offset by rank in the plan: no group of pieces meets in one task.

Cases: a null text counts as empty and packs as its end id alone; a null identifier
stays null; repeated rows are packed each; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from wakeline.llm.common import durable, id_text, text_batches, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
ROUNDS = 40
SHARPNESS = 12.0
# Parts of the fractional solution that are tried when it is rounded down.
ROUNDING = (1.0, 0.95, 0.9, 0.8, 0.6)
BUCKET_ROWS = 1000


class Encoder:
    """Token ids of whole texts by the tokenizer file.

    The file's byte pairs merge in the order of their ids, which is how rank-based
    encoders work too; such an encoder, built from the same file, is several times
    faster and takes texts in Latin letters, where both libraries split alike. All
    other texts, and those with the file's own special strings, go to the tokenizer.
    """

    def __init__(self, path: str):
        import json
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)["model"]
        # Each byte is written as a printable character: itself, or the next unused one from U+0100.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in held["vocab"].items() if token not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["merges"]]
        made = [held["vocab"][left + right] for left, right in pairs]
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ) if made == sorted(made) else None
        self.plain = re.compile("[\t\n -~\u00a1-\u024f]*")
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and self.plain.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    lead = n % capacity if n > capacity else n
    starts = [0, *range(lead, n, capacity)] if lead else list(range(0, n, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; with_ids adds each piece's token ids."""
    where = tokenizer_file(VOCABULARY, path)
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        kinds["ids"] = pa.list_(pa.uint32())

    def run(batches):
        own = encoder(where)
        for ids, texts in text_batches(batches):
            rows, owner = [], []
            for at, text in enumerate(texts):
                codes = np.append(own.encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(codes), capacity)):
                    part = codes[start : start + length]
                    owner.append(at)
                    rows.append((k, start, length, zlib.crc32(part.tobytes()), *([part] if with_ids else [])))
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            arrays = [pa.array(list(c), k if k != pa.list_(pa.uint32()) else pa.list_(pa.int64()))
                      for c, k in zip(columns, kinds.values())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), *arrays], ["doc_id", *kinds])

    return id_text(docs).mapInArrow(run, PIECES + (", ids array<bigint>" if with_ids else ""))


def price_rooms(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for every room up to capacity: greatest price, and the length chosen last (-1: none)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.searchsorted(lengths, room, side="right")
        if fits:
            gains = prices[:fits] + value[room - lengths[:fits]]
            best = int(np.argmax(gains))
            if gains[best] > value[room]:
                value[room], choice[room] = gains[best], best
    return value, choice


def read_room(room: int, choice: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Places in ``lengths`` of the items that fill a room best."""
    found = []
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            found.append(int(choice[room]))
            room -= int(lengths[found[-1]])
    return found


def covering_program(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Configurations and fractional numbers that cover all counts, by multiplicative weights.

    A price falls exponentially with its length's coverage. Each round solves one
    knapsack, which prices the best configuration around every length; those around
    the least covered lengths are bought, each for a fixed share of the demand. The
    sum is scaled so that the least covered length is just met.
    """
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(x)] for x in lengths], float)
    covered = np.zeros(len(lengths))  # shares of the demand
    bought: dict[tuple, float] = {}
    step = 2.0 / rounds
    for _ in range(8 * rounds):
        low = covered.min()
        if low >= 1.0:
            break
        prices = lengths * np.exp(-SHARPNESS * (covered - low))
        _, choice = price_rooms(prices, lengths, capacity)
        for k in np.flatnonzero(covered <= low + step)[::-1]:
            if covered[k] > low + step:
                continue  # covered by a configuration of this round
            places, n = np.unique([int(k), *read_room(capacity - int(lengths[k]), choice, lengths)], return_counts=True)
            amount = step * (demand[places] / n).min()
            covered[places] += n * amount / demand[places]
            key = tuple(zip(places.tolist(), n.tolist()))
            bought[key] = bought.get(key, 0.0) + amount
    low = covered.min()
    scale = 1.0 / low if low > 0 else 0.0
    return [({int(lengths[k]): n for k, n in key}, amount * scale) for key, amount in bought.items()]


@dataclass
class Plan:
    """For each length, ranges of ranks and where they go; ``sequences`` in all."""

    length: np.ndarray
    first: np.ndarray  # first rank of the range
    copies: np.ndarray  # places of this length in one sequence
    base: np.ndarray  # first sequence
    offset: np.ndarray  # of the first place in a sequence
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset for each (length, rank)."""
        stride = np.int64(1) << 44  # more pieces of a length than any corpus holds
        at = np.searchsorted(self.length * stride + self.first, length * stride + rank, side="right") - 1
        inside = rank - self.first[at]
        return self.base[at] + inside // self.copies[at], self.offset[at] + inside % self.copies[at] * length


def best_fit_counts(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over counts: equal sequences are filled together.

    Each step opens the longest length left and repeatedly adds the longest that
    still fits, as often as the counts allow, so its work depends on the number of
    lengths and not of pieces.
    """
    left = {k: v for k, v in left.items() if v > 0}
    made: list[tuple[dict[int, int], int]] = []
    while left:
        room, found = capacity, {}
        for length in sorted(left, reverse=True):
            if length <= room and left[length] > 0:
                take = min(room // length, left[length])
                found[length] = take
                room -= take * length
        times = min(left[k] // v for k, v in found.items())
        for k, v in found.items():
            left[k] -= v * times
            if left[k] == 0:
                del left[k]
        made.append((found, times))
    return made


def round_down(program, counts: dict[int, int], part: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of a part of the program's configurations, and best fit of what is left."""
    left = dict(counts)
    chosen = []
    for found, amount in program:
        times = min([int(part * amount), *[left[k] // v for k, v in found.items()]])
        if times > 0:
            chosen.append((found, times))
            for k, v in found.items():
                left[k] -= v * times
    return chosen + best_fit_counts(left, capacity)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Whole configurations for all counts: rounded program, then best fit of what is left."""
    program = sorted(covering_program(counts, capacity, rounds), key=lambda x: -x[1]) if counts else []
    plans = [round_down(program, counts, part, capacity) for part in ROUNDING]
    chosen = min(plans, key=lambda plan: sum(times for _, times in plan))
    used = dict.fromkeys(counts, 0)
    rows, base = [], 0
    for found, times in chosen:
        offset = 0
        for length in sorted(found, reverse=True):
            k = found[length]
            rows.append((length, used[length], k, base, offset))
            used[length] += k * times
            offset += k * length
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(len(rows), 5).T
    return Plan(*columns, sequences=base)


def assign(parts: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to stored pieces.

    A length is dealt into buckets of about BUCKET_ROWS pieces, ranked inside each;
    a prefix sum over the buckets' sizes makes the ranks those of the whole length.
    """
    spark = parts.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(counts, capacity, rounds)
    # At most ``capacity`` rows.
    shares = spark.createDataFrame(
        [(length, 1 + n // BUCKET_ROWS) for length, n in counts.items()], "length bigint, _parts bigint"
    )
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts")).alias("_bucket")
    parts = parts.join(F.broadcast(shares), "length").select(*[F.col(c) for c in parts.columns], spread)
    sizes = parts.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = parts.withColumn("_row", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"])
    names = [f.name for f in parts.schema if f.name != "_bucket"]
    ranked = ranked.select(*names, (F.col("_before") + F.col("_row")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "_bucket")

    def run(batches):
        for batch in batches:
            sequence, offset = plan.place(
                batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(durable(pieces(docs, capacity, path)), capacity, rounds)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """sequence_id and ids, the filled sequences. A sequence holds at most ``capacity`` ids, so groups are bounded."""
    with_ids = pieces(docs, capacity, path, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "piece", "ids_crc32")]
    joined = packed.alias("a").join(with_ids.dropDuplicates(["doc_id", "piece", "ids_crc32"]).alias("b"), same)
    grouped = joined.groupBy("a.sequence_id").agg(F.array_sort(F.collect_list(F.struct("a.offset", "b.ids"))).alias("p"))
    return grouped.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
