"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda: a heap of adjacent symbol pairs whose concatenation is a piece, best score first, leftmost
first among equals.  The top pair is merged and its new neighbours enter the agenda; pairs whose symbols have changed
since are skipped.  The agendas of many short units are rows of a matrix, all of which lose their tops at the same time.  Symbols that end as no piece become byte pieces.  Pieces never hold the space mark after another
character, so a text is cut in front of each run of marks and around characters that occur in no longer piece; units are
encoded once and remembered in a table of bounded size.

Every whole text is also given to the sentencepiece library.  ``checked`` says whether both agree; where a text's ids do not,
the library's are returned.  Decoding maps ids to the bytes of their pieces, joins them and drops the added space.

Edge cases: a null text is encoded as the empty text, which has no ids; repeated rows give repeated rows; any doc_id,
null included, is passed through; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices

MARK = "▁"
REMEMBERED = 250_000
#: Text is taken in runs of so many bytes: the lists and strings of a run take some 50 times that.
SLICE = 256 << 10
#: Type code of 32-bit integers in Python's arrays.
INT32 = "i"
SHORT = 24
#: From so many units on their agendas are a matrix, of at most so many rows.
MANY, ROWS = 256, 4096
NEVER = float("inf")

codecs.register_error("one-by-one", lambda e: ("�", e.start + 1))


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = [b"" if lib.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.surface[lib.unk_id()] = " ⁇ ".encode()
        self.breaks = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i)}
        inner = {p for p in self.ids if MARK in p[1:] and p.strip(MARK)}
        if inner:
            raise ValueError(f"pieces hold a space mark inside: {sorted(inner)[:3]}")
        merging = "".join(re.escape(c) for c in sorted({c for p in self.ids if len(p) > 1 for c in p} - {MARK}))
        self.unit = re.compile(f"{MARK}+[{merging}]*|[{merging}]+|[^{merging}{MARK}]")
        #: Two generations: when the younger is full the elder goes, and what is met again moves up.
        self.seen: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self._number_pairs(size)

    def _number_pairs(self, size: int) -> None:
        """The symbol of each character that is a piece, and each pair of pieces that makes one, sorted, with what it makes and
        the place of its rank among all ranks (equal ones share it).  Number ``size`` is no symbol, and the last pair none."""
        ids, self.none = self.ids, size
        single = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.symbol = np.full(max(single, default=0) + 2, size, np.int32)
        self.symbol[list(single)] = list(single.values())
        splits = sorted((ids[p[:k]] * (size + 1) + ids[p[k:]], i, self.rank[p]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pairs = np.array([*(x[0] for x in splits), np.iinfo(np.int64).max], np.int64)
        self.made = np.array([*(x[1] for x in splits), size], np.int32)
        self.place = np.unique([*(x[2] for x in splits), NEVER], return_inverse=True)[1].astype(np.int32)

    def merge(self, unit: str) -> tuple[int, ...]:
        """The ids of one unit, by the agenda."""
        symbols = self._merge_short(unit) if len(unit) <= SHORT else self._merge_long(unit)
        ids, out = self.ids, []
        for s in symbols:
            found = ids.get(s)
            if found is None:
                out.extend([self.byte_ids[b] for b in s.encode()])
            else:
                out.append(found)
        return tuple(out)

    def _merge_short(self, unit: str) -> list[str]:
        """The agenda of a short unit is a plain list of ranks: its minimum, the first of equals, is the top."""
        rank = self.rank.get
        symbols = list(unit)
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, unit[1:])]
        while agenda:
            top = min(agenda)
            if top == NEVER:
                break
            i = agenda.index(top)
            symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NEVER)
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NEVER)
        return symbols

    def _merge_long(self, unit: str) -> list[str]:
        """The agenda of a long unit is a heap; entries whose symbols have changed since are skipped."""
        rank = self.rank
        symbols = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != len(pair) or after[i] != j:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heapq.heappush(agenda, (rank[new], i, k, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heapq.heappush(agenda, (rank[new], h, i, new))
        return [s for s in symbols if s]

    def merge_all(self, units: list[str]) -> list[bytes]:
        """What ``merge`` gives for each unit, as 32-bit integers one behind the other."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[np.minimum(codes, len(self.symbol) - 1)]
        starts = np.cumsum(lengths) - lengths
        plain = (lengths <= SHORT) & (np.maximum.reduceat(symbols, starts) < self.none)
        out = [b""] * len(units)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = array(INT32, self.merge(units[i])).tobytes()
        order = np.flatnonzero(plain)
        order = order[np.argsort(lengths[order], kind="stable")]
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            left = self._merge_rows(symbols, starts[rows], lengths[rows])
            ends = (4 * np.cumsum((left < self.none).sum(1))).tolist()
            data = left[left < self.none].tobytes()
            for i, start, end in zip(rows.tolist(), [0, *ends], ends):
                out[i] = data[start:end]
        return out

    def _merge_rows(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A row for each unit, of what is left of its symbols; places without one hold ``none``, as the last column does."""
        n, width = len(starts), int(lengths.max()) + 1
        column = np.arange(width)
        inside = column < lengths[:, None]
        own = np.where(inside, symbols[np.where(inside, starts[:, None] + column, 0)], self.none).astype(np.int32).ravel()
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        before[::width] += width  # the first of a row stands behind its last column
        pair = self._pair(own, np.append(own[1:], self.none))
        agenda = self.place[pair]
        never = self.place[-1]
        live = np.arange(n)
        while len(live):
            i = agenda.reshape(n, width)[live].argmin(1) + live * width
            go = agenda[i] < never
            live, i = live[go], i[go]
            j = after[i]
            h, k = before[i], after[j]
            own[i] = new = self.made[pair[i]]
            own[j], agenda[j] = self.none, never
            after[i], before[k] = k, i
            pair[i] = x = self._pair(new, own[k])
            agenda[i] = self.place[x]
            pair[h] = x = self._pair(own[h], new)
            agenda[h] = self.place[x]
        return own.reshape(n, width)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where two symbols stand among the pairs; the last place if they make no piece."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, at, len(self.pairs) - 1)

    def differing(self, units: list[str]) -> list[str]:
        """The units that the agenda and the library split differently.

        The library puts a mark before each text.  A unit that starts with a mark gets it that way; any other is given
        behind a line feed, which no piece contains, and the ids of mark and line feed are cut off.
        """
        texts = [u[1:].replace(MARK, " ") if u[0] == MARK else "\n" + u for u in units]
        skip = len(self.library.encode("\n"))
        out = []
        for unit, text, ids in zip(units, texts, self.library.encode(texts, num_threads=1)):
            if unit[0] != MARK:
                ids = ids[skip:]
            elif not text:  # a lone mark: the library gives no ids for the empty text
                ids = [self.ids[MARK]]
            if self.merge(unit) != tuple(ids):
                out.append(unit)
        return out

    def encode(self, texts: list[str]) -> tuple[list[list[int]], int]:
        """The ids of each text by the agenda, and how many units of the texts that the library splits otherwise differ."""
        ids = [array(INT32, x).tolist() for x in self.packed(texts)]
        other = [self.split(t) for t, own, truth in zip(texts, ids, self.library.encode(texts, num_threads=1)) if own != truth]
        return ids, len(self.differing(list(set().union(*other))))

    def split(self, text: str) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text by the agenda, as 32-bit integers one behind the other."""
        if len(self.seen) > REMEMBERED:
            self.elder, self.seen = self.seen, {}
        seen, elder = self.seen, self.elder
        split = [self.split(t) for t in texts]
        new = []
        for unit in set().union(*split).difference(seen):
            if unit in elder:
                seen[unit] = elder[unit]
            else:
                new.append(unit)
        seen.update(zip(new, self.merge_all(new) if len(new) >= MANY else [array(INT32, self.merge(u)).tobytes() for u in new]))
        return [b"".join(map(seen.__getitem__, units)) for units in split]

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        if not self.breaks.isdisjoint(ids):  # a byte sequence ends at a control or unknown piece
            runs: list[list[int]] = [[]]
            for i in ids:
                if i in self.breaks:
                    runs += [[i], []]
                else:
                    runs[-1].append(i)
            whole = "".join(b"".join([surface[i] for i in x]).decode("utf-8", "one-by-one") for x in runs)
            first = next((x[0] for x in runs if x), None)
            return whole[1:] if first is not None and self.pieces[first].startswith(MARK) else whole
        out = b"".join([surface[i] for i in ids])
        if ids and self.pieces[ids[0]].startswith(MARK):
            out = out[1:]
        return out.decode("utf-8", "one-by-one")


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One for each model and process."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = list(accumulate((len(x) // 4 for x in packed), initial=0))
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def tokenize(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded, checked`` for every row of ``docs`` (doc_id, text).

    The model file (some 0.5 MB, read once by the driver) travels with the task.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        own = codec(model)
        for part in slices(batches, limit=SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = own.packed(texts)
            truth = own.library.encode(texts, num_threads=1)
            decoded = [own.decode(x) for x in truth]  # what is returned has the library's ids, by the agenda or else by it
            truth = [array(INT32, x).tobytes() for x in truth]
            agreed = [a == b for a, b in zip(ids, truth)]
            ids = [a if a == b else b for a, b in zip(ids, truth)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), _lists(ids), pa.array(decoded, pa.string()), pa.array(agreed, pa.bool_())],
                names=["doc_id", "ids", "decoded", "checked"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string, checked boolean")


def op10_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("checked").alias("agenda_equals_library"),
    )
