"""SentencePiece encoding with seeded merge dropout, and decoding.

A word's characters are merged by the vocabulary's scores from an agenda, highest score and then leftmost first,
as the merge type of the model does; each candidate taken from the agenda is skipped with the dropout rate. Which
ones are skipped is drawn for every occurrence of a word, by a keyed hash of seed, doc_id and the word's place, as gaps
of geometric length between skipped candidates. All words of a slice are cut side by side, a candidate of each at a time,
as columns of arrays; occurrences that skip none are cut once per word and slice. What is not in the vocabulary becomes byte
pieces. With dropout 0 the pieces are the library's.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import BASE, MASK, ODD, prepare, read, slices, spread_bits
from tidewater.llm.tokens import vocabulary

VOCABULARY = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1234
CACHE_WORDS = 150_000
GAP = "▁"
SHORT_WORD = 48
CACHED_SKIPS = 2
NEVER = 1 << 60
# Words of up to LONG_WORD characters are cut side by side, about CELLS characters at a time.
PLACE_BITS = 8
LONG_WORD = 1 << PLACE_BITS
CELLS = 1 << 18
NONE = (1 << 31) - 1
SLOT_BITS = 20


class Pieces:
    """Encoder and decoder over the vocabulary of a model file.

    Ids are remembered by word and skipped candidates (at most CACHED_SKIPS, in words of at most SHORT_WORD), in two
    generations of at most CACHE_WORDS before the last text; other occurrences are cut each for itself.
    """

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        order = {s: n for n, s in enumerate(sorted({-model.get_score(i) for i in ids.values()}))}
        self.rank = {p: order[-model.get_score(i)] for p, i in ids.items()}
        self.raw = {p: i.to_bytes(4, "little") for p, i in ids.items()}
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw_byte = [i.to_bytes(4, "little") for i in byte_ids]
        self.bytes = [p.replace(GAP, " ").encode() for p in self.pieces]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.dropout, self.seed = dropout, seed
        # Ascending chances, in 2 ** -53, of at least so many candidates before the next skipped one, from the last to 1.
        stay = 1.0 - dropout
        far = ceil(37 / -np.log(stay)) if 0 < dropout < 1 else 0
        self.chances = (stay ** np.arange(far, 0, -1) * float(1 << 53)).astype(np.int64)
        self.chance_list = self.chances.tolist()
        self.young: dict[tuple[str, tuple[int, ...]], tuple[bytes, int]] = {}
        self.old: dict[tuple[str, tuple[int, ...]], tuple[bytes, int]] = {}
        self.taken = 0

    def _skips(self, key: int) -> Iterator[int]:
        """Numbers of the candidates that an occurrence skips, ascending."""
        at, turn = -1, 0
        while self.dropout:
            at += 1 + len(self.chance_list) - bisect_left(self.chance_list, _draw(key, turn) + 1)
            yield at
            turn += 1

    def _first_skips(self, keys: np.ndarray) -> np.ndarray:
        """The first of `_skips` for many keys."""
        drawn = (spread_bits(keys) >> np.uint64(11)).astype(np.int64)
        return len(self.chances) - np.searchsorted(self.chances, drawn + 1)

    def word_ids(self, word: str, key: int | tuple[int, ...]) -> bytes:
        """Ids of one word by agenda processing; `word` holds GAP for its spaces, `key` the occurrence or its skips."""
        cuts = (self._short if len(word) <= SHORT_WORD else self._long)(word, key)
        raw, out = self.raw, []
        for piece in [word[a:b] for a, b in zip(cuts, cuts[1:])]:
            ids = raw.get(piece)
            out.append(ids if ids is not None else b"".join([self.raw_byte[x] for x in piece.encode()]))
        return b"".join(out)

    def _short(self, word: str, key: int | tuple[int, ...]) -> list[int]:
        """Cuts of a short word: the agenda is the list of its neighbouring pairs' ranks, NEVER where there is none."""
        rank, skips = self.rank.get, self._skips(key) if isinstance(key, int) else iter(key)
        skip, taken = next(skips, NEVER), -1
        cuts = list(range(len(word) + 1))
        agenda = [rank(word[i:i + 2], NEVER) for i in range(len(word) - 1)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            at = agenda.index(best)
            taken += 1
            if taken == skip:
                agenda[at] = NEVER
                skip = next(skips, NEVER)
                continue
            del cuts[at + 1], agenda[at]
            if at:
                agenda[at - 1] = rank(word[cuts[at - 1]:cuts[at + 1]], NEVER)
            if at < len(agenda):
                agenda[at] = rank(word[cuts[at]:cuts[at + 2]], NEVER)
        self.taken = taken + 1
        return cuts

    def _long(self, word: str, key: int | tuple[int, ...]) -> list[int]:
        """The same cuts with a heap for the agenda, in time that grows little faster than the word."""
        size, rank = len(word), self.rank.get
        skips = self._skips(key) if isinstance(key, int) else iter(key)
        skip, taken = next(skips, NEVER), -1
        end, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
        agenda: list[tuple[int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            found = rank(word[a:end[b]])
            if found is not None:
                heapq.heappush(agenda, (found, a, b, end[b]))

        for i in range(size - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, stop = heapq.heappop(agenda)
            if not alive[a] or not alive[b] or end[a] != b or end[b] != stop:
                continue
            taken += 1
            if taken == skip:
                skip = next(skips, NEVER)
                continue
            alive[b] = False
            end[a] = stop
            if stop < size:
                before[stop] = a
                propose(a, stop)
            if before[a] >= 0:
                propose(before[a], a)
        self.taken = taken + 1
        return [i for i in range(size) if alive[i]] + [size]

    def words(self, text: str) -> list[str]:
        """Text with the dummy gap in front, cut before each run of gaps; no piece has a gap after another character."""
        marked = (" " + text).split(" ")
        out, gaps = [], 0
        for chunk in marked[1:]:
            gaps += 1
            if chunk:
                out.append(GAP * gaps + chunk)
                gaps = 0
        if gaps:
            out.append(GAP * gaps)
        return out

    def encode(self, text: str | None, doc: int | None = 0) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit bytes; none for a null or empty text.

        A GAP character of the text itself is written as its three bytes, so that it is not taken for a space.
        """
        import xxhash

        if not text:
            return b""
        words, out = self.words(text) if GAP not in text else self._literal(text), []
        if self.dropout:
            document = np.uint64(xxhash.xxh64_intdigest(str(doc), self.seed & MASK))
            keys = spread_bits(document + np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(ODD))
            each = zip(words, keys.tolist(), self._first_skips(keys).tolist())
        else:
            each = ((word, 0, NEVER) for word in words)
        young = self.young
        for word, key, skip in each:
            whole = young.get((word, ())) or self._held(word, ())
            out.append(whole[0] if skip >= whole[1] else self._varied(word, key, skip))
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young
        return b"".join(out)

    def _held(self, word: str, skips: tuple[int, ...]) -> tuple[bytes, int]:
        """Ids of a word that skips these candidates only, and how many candidates it takes."""
        found = self.young.get((word, skips)) or self.old.get((word, skips))
        if found is None:
            found = self._ids(word, skips), self.taken
            if "\x00" + GAP in word:
                found = found[0], NEVER if self.dropout else 0
        self.young[word, skips] = found
        return found

    def _varied(self, word: str, key: int, skip: int) -> bytes:
        """Ids of an occurrence whose first skipped candidate is `skip`."""
        if len(word) > SHORT_WORD or "\x00" + GAP in word:
            return self._ids(word, key)
        skips, turn = (skip,), 1
        while len(skips) <= CACHED_SKIPS:
            ids, taken = self._held(word, skips)
            skip += 1 + len(self.chance_list) - bisect_left(self.chance_list, _draw(key, turn) + 1)
            if skip >= taken:
                return ids
            skips, turn = (*skips, skip), turn + 1
        return self._ids(word, key)

    def _literal(self, text: str) -> list[str]:
        return self.words(text.replace(GAP, "\x00" + GAP))

    def _ids(self, word: str, key: int | tuple[int, ...]) -> bytes:
        first, *rest = word.split("\x00" + GAP)
        out = [self.word_ids(first, key)]
        for n, part in enumerate(rest, 1):
            own = (key + n * BASE) & MASK if isinstance(key, int) else key
            out += [self.raw_byte[b] for b in GAP.encode()] + [self.word_ids(part, own)]
        return b"".join(out)

    def encode_all(self, texts: list[str | None], docs: list[int | None]) -> list[bytes]:
        """`encode` of many texts at once."""
        import xxhash

        out, words, keys, spans = [b""] * len(texts), [], [], []
        for n, (text, doc) in enumerate(zip(texts, docs)):
            if text and GAP in text:
                out[n] = self.encode(text, doc)
            elif text:
                found = self.words(text)
                document = np.uint64(xxhash.xxh64_intdigest(str(doc), self.seed & MASK))
                keys.append(spread_bits(document + np.arange(1, len(found) + 1, dtype=np.uint64) * np.uint64(ODD)))
                spans.append((n, len(words), len(words) + len(found)))
                words += found
        if not words:
            return out
        key = np.concatenate(keys)
        number: dict[str, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        distinct = list(number)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        skip = self._first_skips(key) if self.dropout else np.full(len(words), NONE)
        # A word of n characters has at most n - 1 candidates while none is skipped.
        long = sizes[code] > LONG_WORD
        whole = (skip >= sizes[code] - 1) & ~long
        plain, job = np.unique(code[whole], return_inverse=True)
        varied = np.flatnonzero(~whole & ~long)
        jobs = np.empty(len(words), np.int64)
        jobs[whole], jobs[varied] = job, len(plain) + np.arange(len(varied))
        ids, counts = self._side_by_side(
            distinct, sizes, np.concatenate([plain, code[varied]]),
            np.concatenate([np.full(len(plain), NONE), skip[varied]]), np.concatenate([np.zeros(len(plain), np.uint64), key[varied]]))
        at = np.flatnonzero(long)
        if len(at):
            apart = [np.frombuffer(self._ids(distinct[c], k), "<u4") for c, k in zip(code[at].tolist(), key[at].tolist())]
            jobs[at] = len(counts) + np.arange(len(at))
            ids, counts = np.concatenate([ids, *apart]), np.concatenate([counts, [len(a) for a in apart]])
        starts = np.cumsum(counts) - counts
        ends = np.cumsum(counts[jobs])
        taken = np.repeat(starts[jobs] - ends + counts[jobs], counts[jobs]) + np.arange(ends[-1])
        raw, ends = ids[taken].astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        for n, a, b in spans:
            out[n] = raw[ends[a]:ends[b]]
        return out

    def _arrays(self) -> None:
        """Symbols of characters, and of each two symbols that make a piece its rank and symbol, as a hash table.

        A piece's symbol is its id; that of a character which is no piece lies as far behind them as its code point.
        """
        size = len(self.pieces)
        symbol = {p: int.from_bytes(raw, "little") for p, raw in self.raw.items()}
        self.symbols = size + np.arange(0x110000, dtype=np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        pairs = []
        for p, i in symbol.items():
            for cut in range(1, len(p)):
                left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                if (left is not None or cut == 1) and (right is not None or cut == len(p) - 1):
                    pairs.append((size + ord(p[0]) if left is None else left, size + ord(p[-1]) if right is None else right, self.rank[p], i))
        left, right, rank, made = np.array(pairs, np.int64).reshape(-1, 4).T
        keys = left << 32 | right
        self.slot_keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_ranks, self.slot_made = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slot_keys[slots[todo]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.slot_keys[slots[put]], self.slot_ranks[slots[put]], self.slot_made[slots[put]] = keys[put], rank[put], made[put]
            todo = todo[self.slot_keys[slots[todo]] != keys[todo]]
            slots[todo] = slots[todo] + 1 & (1 << SLOT_BITS) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(ODD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _made_of(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place as one number, NONE for no piece, and symbol of the pieces that two symbols each make."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        held = self.slot_keys[slots]
        lost = np.flatnonzero((held != keys) & (held >= 0))
        while len(lost):
            slots[lost] = slots[lost] + 1 & (1 << SLOT_BITS) - 1
            held[lost] = self.slot_keys[slots[lost]]
            lost = lost[(held[lost] != keys[lost]) & (held[lost] >= 0)]
        return np.where(held == keys, self.slot_ranks[slots] << PLACE_BITS | place, NONE).astype(np.int32), self.slot_made[slots]

    def _side_by_side(self, words: list[str], sizes: np.ndarray, code: np.ndarray, skip: np.ndarray,
                      key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words[code] one after the other, and how many each has; `skip` is the first skipped candidate."""
        if not hasattr(self, "slot_keys"):
            self._arrays()
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        first = np.cumsum(sizes) - sizes
        order = np.argsort(sizes[code], kind="stable")
        found, counts, at = [], np.zeros(len(code), np.int64), 0
        while at < len(order):
            # Columns of ascending size: those up to the first that makes the block too large, at least one.
            ahead = sizes[code[order[at:at + CELLS]]]
            fit = max(1, int(np.argmax(np.append(ahead * np.arange(1, len(ahead) + 1) > CELLS, True))))
            now = order[at:at + fit]
            final = self._cut(points, first[code[now]], sizes[code[now]], skip[now].copy(), key[now])
            found.append(final.T[final.T >= 0])
            counts[now] = (final >= 0).sum(axis=0)
            at += fit
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        # From the order of the columns to that of the words.
        before = np.zeros(len(code), np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        flat = flat[np.repeat(before - np.cumsum(counts) + counts, counts) + np.arange(len(flat))]
        return self._spelled(flat, counts)

    def _cut(self, points: np.ndarray, first: np.ndarray, sizes: np.ndarray, skip: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Symbols of each word's pieces, a column for each word, at the places where they start; -1 elsewhere.

        As in `_short`, the agenda holds a candidate for every place, and each word takes its best one in every round.
        """
        n, most = len(first), int(sizes.max())
        rows = np.arange(most)[:, None]
        inside = rows < sizes
        symbols = np.where(inside, self.symbols[points[np.where(inside, first + rows, 0)]], -1)
        final = np.full((most, n), -1, np.int32)
        agenda, made = np.full((most, n), NONE, np.int32), np.zeros((most, n), np.int32)
        if most > 1:
            place = np.broadcast_to(rows[:-1], (most - 1, n))[inside[1:]]
            agenda[:-1][inside[1:]], made[:-1][inside[1:]] = self._made_of(symbols[:-1][inside[1:]], symbols[1:][inside[1:]], place)
        after = np.broadcast_to(rows + 1, (most, n)).copy()
        before = np.broadcast_to(rows - 1, (most, n)).copy()
        column, turn, taken = np.arange(n), np.ones(n, np.uint64), 0
        while True:
            best = agenda.min(axis=0)
            going = np.flatnonzero(best != NONE)
            if len(going) < 0.75 * n or not len(going):
                ended = np.flatnonzero(best == NONE)
                final[:, column[ended]] = symbols[:, ended]
                if not len(going):
                    return final
                symbols, agenda, made, after, before = (m.take(going, axis=1) for m in (symbols, agenda, made, after, before))
                column, turn, skip, key, sizes, best = (v[going] for v in (column, turn, skip, key, sizes, best))
                n, going = len(going), np.arange(len(going))
            s, c, m, nx, pv = (x.reshape(-1) for x in (symbols, agenda, made, after, before))
            a = (best[going] & LONG_WORD - 1).astype(np.int64)
            skipped = skip[going] == taken
            if skipped.any():
                who = going[skipped]
                c[a[skipped] * n + who] = NONE
                drawn = (spread_bits(key[who] + turn[who] * np.uint64(BASE)) >> np.uint64(11)).astype(np.int64)
                skip[who] += 1 + len(self.chances) - np.searchsorted(self.chances, drawn + 1)
                turn[who] += np.uint64(1)
                going, a = going[~skipped], a[~skipped]
            taken += 1
            here = a * n + going
            b = nx[here]
            there = b * n + going
            stop = nx[there]
            s[here], s[there], c[there], nx[here] = m[here], -1, NONE, stop
            more = stop < sizes[going]
            right, c[here[~more]] = stop[more] * n + going[more], NONE
            pv[right] = a[more]
            c[here[more]], m[here[more]] = self._made_of(s[here[more]], s[right], a[more])
            back = pv[here]
            less = back >= 0
            left = back[less] * n + going[less]
            c[left], m[left] = self._made_of(s[left], s[here[less]], back[less])

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of characters that are no piece as the ids of their bytes; the words' counts of ids with them."""
        apart = np.flatnonzero(symbols >= len(self.pieces))
        if not len(apart):
            return symbols, counts
        points, which = np.unique(symbols[apart] - len(self.pieces), return_inverse=True)
        spelled = [chr(p).encode() for p in points.tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[apart] = np.array([len(x) for x in spelled])[which]
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        out[starts] = symbols
        for place in range(4):
            ids = np.array([int.from_bytes(self.raw_byte[x[place]], "little") if place < len(x) else 0 for x in spelled])[which]
            has = sizes[apart] > place
            out[starts[apart[has]] + place] = ids[has]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return out, np.diff(ends)

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; byte pieces give their bytes, a gap a space."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()[1:]


def _draw(key: int, turn: int) -> int:
    """53 bits of a keyed hash; for turn 0 those of `spread_bits`."""
    mixed = (key + turn * BASE) & MASK
    mixed = ((mixed ^ mixed >> 30) * 0xBF58476D1CE4E5B9) & MASK
    mixed = ((mixed ^ mixed >> 27) * 0x94D049BB133111EB) & MASK
    return (mixed ^ mixed >> 31) >> 11


def encode(docs: DataFrame, vocabulary_path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text): ids are little-endian unsigned 32-bit binary.

    Every occurrence of a word varies by itself, keyed by doc_id and its place; another seed gives other cuts, and the
    same seed always the same. Null and empty texts have no ids. Equal rows get
    equal ids; a null doc_id stays null; an empty table gives no rows. Other columns are not read.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(vocabulary_path, dropout, seed)
        for part in slices(batches, "text"):
            ids = coder.encode_all(part.column("text").to_pylist(), part.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        walk, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(vocabulary_path, 0.0)
        for part in slices(batches, "ids"):
            texts = [coder.decode(i or b"") for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(walk, "doc_id long, text string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with dropout: number and checksum of the ids, and the decoded text's checksum."""
    docs, path = read(spark, sf_dir, "documents"), vocabulary(VOCABULARY)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(path)
        for part in slices(batches, "ids"):
            held = [i or b"" for i in part.column("ids").to_pylist()]
            texts = [coder.decode(i).encode() for i in held]
            columns = [[len(i) // 4 for i in held], [zlib.crc32(i) for i in held], [zlib.crc32(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32"])

    return encode(docs, path).mapInArrow(walk, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long")
