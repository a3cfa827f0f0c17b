"""Byte-level BPE encoding and decoding by tree concatenation.

A text falls apart at every change from visible characters to white space: no pre-token
spans one, so the pieces between (units) are encoded on their own, each distinct unit of a
task once; a library for ranks encodes plain ones, the tokenizer itself the others.  What has no such change is *unsplit*; its pre-tokens may be long, and merging a
long pre-token step by step costs more than linear time.  A long pre-token is therefore
encoded as a tree: both halves on their own, then the join is mended by re-encoding a window
around it, which grows until its first token equals the left half's token there and its last
token the right half's.  In BPE a token sequence is the encoding of its bytes exactly if
every two neighbours are the encoding of their own bytes; after an agreement every two
neighbours of the result stand side by side in an encoding, so the result is exact.

Pre-tokens of over ``parallel`` bytes are cut into pieces that other tasks encode; the rest
of the tree is then built per pre-token from the encoded pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import text_batches

# Unicode White_Space, as the tokenizer's own expression has it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
# A unit with its white space whose characters every Unicode version classes alike.
PLAIN = re.compile("[ \n][!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
LEAF = 64
LONG = 256
PARALLEL = 1 << 16
MEMO = 1 << 17  # units that a task remembers


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder over one vocabulary file; built once in each Python worker."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(vocabulary)
        alphabet = byte_alphabet()
        self.ids = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items()
                    if all(c in alphabet for c in t)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        pairs = [tuple(bytes(alphabet[c] for c in x) for x in m) for m in merges]
        self.ranks = {
            (self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.memo: dict[str, tuple[int, str, bytes]] = {}
        self.size = np.zeros(1 + max(self.bytes), np.int64)
        for i, t in self.bytes.items():
            self.size[i] = len(t)
        self.fast = None
        made = [joined for _, joined in self.ranks.values()]
        if made == sorted(made) and len(made) + 256 == len(self.ids):  # ids follow the merges
            self.fast = tiktoken.Encoding(
                "by rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ids, special_tokens={})

    def merge(self, data: bytes) -> list[int]:
        """BPE of a pre-token's bytes, best rank first, leftmost first among equals."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.ranks.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]], found[1]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = joined, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(i)
            offer(before[i])
        return [i for i in ids if i >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both: the windows around the join double until the
        outer tokens of the window agree with both sides."""
        k = 2
        while left and right:
            a, b = left[-k:], right[:k]
            whole = k >= len(left) and k >= len(right)
            window = self.merge(b"".join(self.bytes[i] for i in [*a, *b]))
            agrees_left = k >= len(left) or window[0] == a[0]
            agrees_right = k >= len(right) or window[-1] == b[-1]
            if whole or agrees_left and agrees_right:
                return [*left[: -len(a)], *window, *right[len(b) :]]
            k *= 2
        return left or right

    def tree(self, data: bytes) -> list[int]:
        """A pre-token of any length: leaves, joined in pairs up to the whole."""
        level = [self.merge(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            paired = [self.join(a, b) for a, b in zip(level[::2], level[1::2])]
            level = paired + level[len(paired) * 2 :]
        return level[0] if level else []

    def pre_tokens(self, text: str) -> list[str]:
        """The text's pre-tokens; the library's expression is linear in the text."""
        spans = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]

    def parts(self, unit: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of a unit between special tokens, and the special tokens."""
        if not any(s in unit for s in self.special):
            yield unit, None
            return
        pattern = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        for piece in re.split(f"({pattern})", unit):
            if piece:
                yield piece, self.special.get(piece)

    def long_unit(self, unit: str, whole: Callable[[bytes], list[int]] | None = None) -> list[int]:
        """An unsplit unit: pre-token by pre-token, long ones as trees."""
        out: list[int] = []
        for piece, special in self.parts(unit):
            if special is not None:
                out.append(special)
                continue
            for token in self.pre_tokens(piece):
                out += (whole or self.tree)(token.encode())
        return out

    def remember(self, units: list[str]) -> None:
        """Encode the units that this task has not met yet."""
        fresh = [u for u in dict.fromkeys(units) if u not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list(dict.fromkeys(units))
        plain = [
            u for u in fresh if self.fast and len(u) <= LONG and PLAIN.fullmatch(u)
            and not any(s in u for s in self.special)
        ]
        for at in range(0, len(plain), 1000):
            self.keep_joined(plain[at : at + 1000])
        if plain:
            fresh = [u for u in fresh if u not in self.memo]
        short = [u for u in fresh if len(u) <= LONG]
        for unit, coded in zip(short, self.library.encode_batch_fast(short, add_special_tokens=False)):
            self.keep(unit, coded.ids)
        for unit in fresh:
            if len(unit) > LONG:
                self.keep(unit, self.long_unit(unit))

    def keep_joined(self, units: list[str]) -> None:
        """Encode units side by side: each begins with white space after a visible character,
        so they do not touch each other, and byte counts say whose the ids are."""
        ids = self.fast.encode_ordinary("".join(units))
        ends = np.cumsum([len(u.encode()) for u in units])
        cuts = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        begin = 0
        for unit, end in zip(units, cuts.tolist()):
            self.keep(unit, ids[begin:end])
            begin = end

    def keep(self, unit: str, ids: list[int]) -> None:
        self.memo[unit] = len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        units = UNIT.findall(text)
        self.remember(units)
        return [int(i) for u in units for i in self.memo[u][1].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def vocabulary_of(path: str) -> str:
    """The vocabulary file's text; its size is that of one vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    vocabulary_path: str,
    digest: bool = False,
    parallel: int = PARALLEL,
) -> DataFrame:
    """``id_col, n_tokens`` and, of every whole text, its ids joined by commas and the text
    decoded from them: in full (``ids, decoded``), or their SHA-256 in lower-case hex where
    ``digest`` (``ids_sha256, decoded_sha256``).

    A null text counts as empty: no token, and the digests of nothing.  Repeated rows and
    ids give one row each; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_of(vocabulary_path))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    schema = f"id long, {names[0]} long, {names[1]} string, {names[2]} string"

    def finish(ids: Sequence[str], decoded: Sequence[bytes]) -> tuple[str, str]:
        joined, text = ",".join(ids), b"".join(decoded).decode("utf-8", errors="replace")
        if not digest:
            return joined, text
        return hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in text_batches(batches, 128):
            coder = coder or Codec(shared.value)  # the task's own, gone with it
            texts = [t or "" for t in batch.column(1).to_pylist()]
            units = [UNIT.findall(t) for t in texts]
            coder.remember(list(chain.from_iterable(units)))
            counts, firsts, seconds = [], [], []
            for found in units:
                n, ids, decoded = zip(*map(coder.memo.__getitem__, found)) if found else ((), (), ())
                a, b = finish(ids, decoded)
                counts.append(sum(n))
                firsts.append(a)
                seconds.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(firsts, pa.string()),
                 pa.array(seconds, pa.string())], ["id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    unsplit = F.col("text").rlike(f"(?:^|[{SPACE}])[^{SPACE}]{{{max(1, parallel // 4)}}}")
    rows = rows.withColumn("long", F.coalesce((F.length("text") * 4 > parallel) & unsplit, F.lit(False)))
    done = rows.filter(~F.col("long")).select("id", "text").mapInArrow(whole, schema)
    return done.unionByName(
        _encode_unsplit(rows.filter("long").select("id", "text"), shared, finish, parallel, schema)
    )


def _encode_unsplit(rows: DataFrame, shared, finish, parallel: int, schema: str) -> DataFrame:
    """Texts with very long unsplit stretches: pieces of long pre-tokens are encoded by
    separate tasks, then each text is put together from its encoded pieces in order."""

    names = [f.split()[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for batch in text_batches(batches, 1):
            key, text, copies = (c[0].as_py() for c in batch.columns)
            pieces: list[tuple[int, bytes, int | None]] = []
            plain: list[str] = []

            def flush() -> None:
                if plain:
                    pieces.append((pieces[-1][0] + 1 if pieces else 0, "".join(plain).encode(), -1))
                    plain.clear()

            for unit in UNIT.findall(text):
                if len(unit) * 4 <= parallel:
                    plain.append(unit)
                    continue
                flush()
                for part, special in coder.parts(unit):
                    for token in [part] if special is not None else coder.pre_tokens(part):
                        data, no = token.encode(), pieces[-1][0] + 1 if pieces else 0
                        step = parallel if special is None else len(data)
                        pieces += [(no, data[i : i + step], special) for i in range(0, len(data), step)]
            flush()
            row = f"{key}:{hashlib.sha256(text.encode()).hexdigest()}"
            n = len(pieces)
            nos, datas, kinds = zip(*pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * n), pa.array([key] * n, pa.int64()), pa.array([copies] * n, pa.int64()),
                 pa.array(range(n), pa.int64()), pa.array(nos, pa.int64()),
                 pa.array(datas, pa.binary()), pa.array(kinds, pa.int64())],
                ["row", "id", "copies", "n", "token", "data", "kind"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for batch in text_batches(batches, 16):
            coded = []
            for data, kind in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                if kind is None:
                    coded.append(coder.tree(data))
                else:
                    coded.append([kind] if kind >= 0 else coder.encode(data.decode()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(coded, pa.list_(pa.int32()))],
                ["row", "id", "copies", "n", "token", "ids"])

    def build(table: pa.Table) -> pa.Table:
        coder = codec(shared.value)
        table = table.sort_by("n")
        out: list[int] = []
        level: list[list[int]] = []
        tokens, coded = table.column("token").to_pylist(), table.column("ids").to_pylist()
        for at, ids in enumerate(coded):
            level.append(ids)
            if at + 1 == len(tokens) or tokens[at + 1] != tokens[at]:
                while len(level) > 1:
                    paired = [coder.join(a, b) for a, b in zip(level[::2], level[1::2])]
                    level = paired + level[len(paired) * 2 :]
                out += level.pop()
        a, b = finish([str(i) for i in out], [coder.bytes[i] for i in out])
        copies = table.column("copies")[0].as_py()
        made = [table.column("id")[0].as_py()], [len(out)], [a], [b]
        kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
        return pa.table([pa.array(v * copies, k) for v, k in zip(made, kinds)], names)

    distinct = rows.groupBy("id", "text").agg(F.count("*").alias("copies"))
    head = "row string, id long, copies long, n long, token long"
    pieces = distinct.mapInArrow(cut, f"{head}, data binary, kind long")
    coded = pieces.repartition("row", "n").mapInArrow(encode, f"{head}, ids array<int>")
    return coded.groupBy("row").applyInArrow(build, schema)
