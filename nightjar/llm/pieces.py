"""A SentencePiece BPE model on the workers: normalisation with source alignment, and pre-tokens.

``Normaliser`` rewrites a text as the model's specification says and records,
for every byte of the result, the byte of the original it came from. The
compiled character map is a double-array trie over UTF-8 prefixes followed by
the replacement strings; at each position the longest prefix in the trie is
replaced, any other character stays as it is.

``Pieces.cut`` splits normalised text into pre-tokens: maximal runs in which
every two neighbouring characters occur side by side inside some piece of the
vocabulary. A merge that crossed the border of such a run would make a piece
that holds the two characters, and there is none, so each pre-token is encoded
on its own, once, and the results are joined.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

SPACE = "▁"
#: Pre-tokens whose encoding a worker remembers; then it starts afresh.
REMEMBERED = 400_000


#: Runs longer than this many characters are hashed one by one.
LONG = 64
RADIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Code points that are hashed at once, so that a worker's working memory doesn't grow with its block; a longer run is taken alone.
STRETCH = 1 << 16


@lru_cache(maxsize=2)
def _values(k: int) -> np.ndarray:
    """A fixed random odd value for each code point."""
    return np.random.default_rng(k).integers(0, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(radix: int, n: int, k: int) -> np.ndarray:
    """radix ** 0 .. radix ** n modulo 2 ** 64."""
    if (k, 0) not in _powers or len(_powers[k, 0]) <= n:
        made = np.full(max(n, STRETCH) + 1, radix, np.uint64)
        made[0] = 1
        _powers[k, 0] = np.multiply.accumulate(made)
    return _powers[k, 0][:n + 1]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of code points, from differences of running sums. The runs are in order and apart."""
    radix, out = RADIX[k], np.zeros(len(starts), np.uint64)
    back = pow(radix, -1, 1 << 64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + STRETCH, "right")))
        n = int(ends[j - 1]) - a
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_values(k)[codes[a:a + n]] * _power(radix, n, 2 * k)[:-1], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * _power(back, n, 2 * k + 1)[starts[i:j] - a]
        i = j
    return out


class CharMap:
    """Longest-prefix replacement through a compiled character map."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at ``at`` and their replacement, or None."""
        units, best, node = self.units, None, 0
        if not units:
            return None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units) or units[node] & ((1 << 31) | 0xFF) != c:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                best = (i + 1 - at, units[node] & ((1 << 31) - 1))
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1]:end]


class Normaliser:
    def __init__(self, spec, suffix: bool = False):
        if suffix:
            raise ValueError("models that write the word mark at the end of words are not supported")
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and not self.trim and self.escape

    def text(self, text: str) -> str:
        if self.plain:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the offset in the original's bytes."""
        data = text.encode()
        if self.plain:
            source = np.frombuffer(data, np.uint8)
            origin = np.repeat(np.arange(len(source), dtype=np.int64), np.where(source == 32, 3, 1))
            head = np.zeros(3 if self.prefix and len(data) else 0, np.int64)
            return self.text(text), np.concatenate([head, origin, [len(source)]])
        out, origin, at, mark = bytearray(), [], 0, SPACE.encode() if self.escape else b" "
        if self.trim:  # leading blanks go, also those that the map makes
            while at < len(data):
                n, new = self._step(data, at)
                if new.strip(b" "):
                    break
                at += n
        if at >= len(data):
            return "", np.array([len(data)], np.int64)
        if self.prefix:
            out += mark
            origin += [at] * len(mark)
        blank = self.trim
        while at < len(data):
            n, new = self._step(data, at)
            if blank and self.trim:
                new = new.lstrip(b" ")
            if new:
                same = len(new) == n and data[at:at + n] == new
                for k, c in enumerate(new):
                    put = mark if c == 32 else bytes([c])
                    out += put
                    origin += [at + k if same else at] * len(put)
                blank = new.endswith(b" ")
            at += n
        if self.trim:
            while out.endswith(mark):
                del out[-len(mark):], origin[-len(mark):]
                at = origin[len(out)] if len(origin) > len(out) else at
        origin.append(at)
        return out.decode(), np.array(origin, np.int64)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found:
            return found
        c = data[at]
        n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        return n, data[at:at + n]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or 4 in kinds or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and without user-defined symbols is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        if not self.normaliser.plain or not self.normaliser.prefix:
            raise ValueError("pre-tokens are encoded by a model that leaves normalised text unchanged")
        self.end = self.library.eos_id()
        #: Bytes of normalised text that each id covers; control pieces cover none.
        self.covers = np.array([1 if p.type == 6 else 0 if p.type in (2, 3) else len(p.piece.encode()) for p in model.pieces], np.int64)
        pairs = sorted({p.piece[i:i + 2] for p in model.pieces if p.type in (1, 5) for i in range(len(p.piece) - 1)})
        letters = {c: i + 1 for i, c in enumerate(sorted({c for pair in pairs for c in pair}))}
        if "\n" in letters:
            raise ValueError("the line feed is a letter of some piece, so it can't keep pre-tokens apart")
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.joins[letters[a], letters[b]] = True
        self.known: dict[str, bytes] = {}

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of normalised texts; for each occurrence its number and the text it is in."""
        return self.cut_hashed(texts)[:3]

    def cut_hashed(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """As ``cut``, and a 64-bit hash of each distinct pre-token, the same in every process."""
        joined = "".join(texts)
        if not joined:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        heads = np.cumsum([0] + [len(t) for t in texts])[:-1]
        letters = self.letter[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        new = np.ones(len(letters) + 1, bool)
        new[1:-1] = ~self.joins[letters[:-1], letters[1:]]
        new[heads[heads < len(letters)]] = True
        bounds = np.flatnonzero(new)
        starts, ends = bounds[:-1], bounds[1:]
        doc = np.searchsorted(heads, starts, "right") - 1
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        key, check = (run_hashes(codes, starts, ends, k) for k in (0, 1))
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            run = joined[starts[i]:ends[i]].encode()
            key[i], check[i] = xxhash.xxh3_64_intdigest(run), xxhash.xxh3_64_intdigest(run, 1)
        keys, first, of = np.unique(key, return_index=True, return_inverse=True)
        if (check[first][of] != check).any():  # two runs share a hash
            found = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            number = {c: i for i, c in enumerate(dict.fromkeys(found))}
            keys = np.fromiter((xxhash.xxh3_64_intdigest(t.encode()) for t in number), np.uint64, len(number))
            return list(number), np.fromiter(map(number.__getitem__, found), np.int64, len(found)), doc, keys
        return [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], of, doc, keys

    def ids(self, tokens: list[str]) -> list[bytes]:
        """The ids of each pre-token, as int32 bytes. A line feed before it keeps the word mark away that the library puts first."""
        known = self.known
        missing = [t for t in tokens if t not in known]
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                known = self.known = {t: known[t] for t in tokens if t in known} if len(tokens) < REMEMBERED else {}
                missing = [t for t in tokens if t not in known]
            for i in range(0, len(missing), 50_000):
                part = missing[i:i + 50_000]
                for t, ids in zip(part, self.library.encode(["\n" + t for t in part], num_threads=1)):
                    known[t] = np.array(ids[2:], "<i4").tobytes()
        return [known[t] for t in tokens]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def blocks(batches, chars: int, rows: int) -> Iterator:
    """Record batches cut so that a block holds at most ``rows`` texts and about ``chars`` characters (column ``text``)."""
    for batch in batches:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (held + n > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)
