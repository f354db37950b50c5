"""Byte-pair encoding and decoding with a published vocabulary file (operator 5).

Method: contiguous rank array.  A short word is held as one row of part boundaries plus the ranks
of its adjacent pairs; the row is scanned for its smallest rank, that boundary is deleted and only
the two neighbouring ranks are refreshed, until no pair has a rank.  Words of one byte length form
one numpy block, so a scan step runs for all of them at once.  Words above ``SHORT`` bytes use a
heap over a linked list, because scanning would be quadratic there.

Every task encodes its own rows: words are told apart by a 64-bit hash together with their length
and both ends, each distinct word of an Arrow batch is merged once, and nothing is shuffled.

Defined cases: null text counts as empty; an empty text has no ids; whole texts are read however
long; strings that spell a special token, whatever it looks like, become its id, as the tokenizers library does by default;
repeated rows are encoded each; an empty table gives no rows; columns other than the two named may have any
name; ids of any vocabulary size are held; a vocabulary file that asks for what this encoder does
not know is refused with an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pandas as pd

SHORT = 48
CHUNK = 4_000_000
SPACE, LETTER, NUMBER, OTHER, UNSEEN = 0, 1, 2, 3, 255
NO_RANK = np.int32(2**31 - 1)
#: Below this code point texts are already composed and lower-casing has no context.
PLAIN = 0x250
FREE, SPREAD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)
_LOADED: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    """Path of the word-end BPE file on this machine; executors resolve it for themselves."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str | None = None) -> "Encoder":
    """The encoder of a vocabulary file, built once in each Python worker."""
    path = path or default_vocabulary()
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if spec["model"].get(k)]
        odd += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t.get("normalized") and not t.get("special")]
        if odd:
            raise ValueError(f"this encoder does not know what the vocabulary file asks for: {sorted(set(odd))}")
        special = {t["content"]: self.library.token_to_id(t["content"]) for t in spec["added_tokens"]}
        longest_first = sorted(special, key=len, reverse=True)
        self.spelled = re.compile("|".join(map(re.escape, longest_first))) if special else None
        self.special = special
        self.surface = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.surface[i] = token
        alphabet = _byte_alphabet()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[alphabet[b] + suffix] for b in range(256)], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._pairs(left, right)
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        self._classify(np.arange(PLAIN))
        rng = np.random.default_rng(20)
        self.place_key = rng.integers(1, 2**63, SHORT + 1, dtype=np.uint64) | np.uint64(1)

    # -- pair ranks -------------------------------------------------------------------------
    def _pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        """An open-addressed table from pairs, as 64-bit keys, to ranks."""
        bits = max(12, (8 * left.size).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, FREE, np.uint64)
        self.slot_rank = np.full((1 << bits) + 64, NO_RANK, np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), ((keys * SPREAD) >> self.shift).tolist())):
            while self.slots[at] != FREE and self.slots[at] != key:
                at += 1
                if at == self.slots.size:
                    self.slots = np.append(self.slots, np.full(64, FREE, np.uint64))
                    self.slot_rank = np.append(self.slot_rank, np.full(64, NO_RANK, np.int32))
            if self.slots[at] != key:
                self.slots[at], self.slot_rank[at] = key, rank
        # A free slot ends every search.
        self.slots, self.slot_rank = np.append(self.slots, FREE), np.append(self.slot_rank, NO_RANK)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = ((key * SPREAD) >> self.shift).astype(np.int64)
        found = self.slots[at]
        out = np.where(found == key, self.slot_rank[at], NO_RANK)
        more = np.nonzero((found != key) & (found != FREE))
        while more[0].size:
            at[more] += 1
            found = self.slots[at[more]]
            hit = found == key[more]
            out[tuple(x[hit] for x in more)] = self.slot_rank[at[more]][hit]
            go = ~hit & (found != FREE)
            more = tuple(x[go] for x in more)
        return out

    # -- words ------------------------------------------------------------------------------
    def _classify(self, points: np.ndarray) -> None:
        """Character classes as the library's own splitter sees them."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            if 0xD800 <= p <= 0xDFFF:
                continue
            c = chr(p)
            if len(split(f"a{c}a")) == 1:
                kind = LETTER
            else:
                kind = {1: OTHER, 2: SPACE}.get(len(split(f"!{c}!")), NUMBER)
            self.classes[p] = kind

    def _kinds(self, buf: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kinds = self.classes[:256][buf]
        lead = np.nonzero(buf >= 0xC0)[0]
        if lead.size:
            b = buf[lead].astype(np.int64)
            size = 2 + (b >= 0xE0) + (b >= 0xF0)
            point = np.where(size == 2, b & 0x1F, np.where(size == 3, b & 0x0F, b & 0x07))
            for k in (1, 2, 3):
                has = size > k
                point[has] = (point[has] << 6) | (buf[lead[has] + k] & 0x3F)
            kind = self.classes[point]
            if (new := point[kind == UNSEEN]).size:
                self._classify(np.unique(new))
                kind = self.classes[point]
            kinds[lead] = kind
            for k in (1, 2, 3):
                has = size > k
                kinds[lead[has] + k] = kind[has]
        return kinds

    def _split(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and byte lengths of the words in a buffer that ends with white space."""
        kinds = self._kinds(buf)
        before = np.empty_like(kinds)
        before[0], before[1:] = SPACE, kinds[:-1]
        changed = kinds != before
        start = changed & (kinds != SPACE)
        start |= (kinds == NUMBER) & ((buf & 0xC0) != 0x80)
        quote = np.nonzero(start & (buf == 0x27))[0]
        if quote.size:
            quote = quote[kinds[quote + 1] == LETTER]
            a, b = buf[quote + 1], buf[np.minimum(quote + 2, buf.size - 1)]
            short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            pair = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
            for took, n in ((short, 2), (pair, 3)):
                q = quote[took]
                start[q + 1] = False
                changed[q + 1] = False
                start[q + n] |= kinds[q + n] == LETTER
                changed[q + n] = True
        edge = np.nonzero(start | (changed & (kinds == SPACE)))[0]
        own = start[edge]
        ends = np.append(edge[1:], buf.size)
        return edge[own], (ends - edge)[own]

    def _hash(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mixes a word's eight-byte lanes; the buffer must go on for eight bytes after a word."""
        h = sizes.astype(np.uint64)
        for k in range(0, SHORT, 8):
            own = slice(None) if k == 0 else np.nonzero(sizes > k)[0]
            if k and not own.size:
                break
            lane = (_lanes(buf, starts[own] + k, sizes[own] - k) + self.place_key[k]) * self.place_key[k + 1]
            lane ^= lane >> np.uint64(31)
            h[own] += lane * self.place_key[k + 2]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)

    # -- merging ----------------------------------------------------------------------------
    def merge_block(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block of equally long words, one row after another, and counts."""
        n, width = block.shape
        parts = self.inner[block]
        parts[:, -1] = self.last[block[:, -1]]
        out, counts = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        rows = np.arange(n)
        while rows.size:
            w = parts.shape[1]
            if w > 1:
                at = ranks.argmin(1)
                best = ranks[np.arange(rows.size), at]
                done = best == NO_RANK
            else:
                done = np.ones(rows.size, bool)
            if done.any():
                out[rows[done], :w] = parts[done]
                counts[rows[done]] = w
                go = ~done
                rows, parts = rows[go], parts[go]
                if not rows.size:
                    break
                ranks, at, best = ranks[go], at[go], best[go]
            k = np.arange(rows.size)
            parts[k, at] = self.merged[best]
            keep = np.ones(parts.shape, bool)
            keep[k, at + 1] = False
            parts = parts[keep].reshape(rows.size, w - 1)
            keep = np.ones(ranks.shape, bool)
            keep[k, at] = False
            ranks = ranks[keep].reshape(rows.size, w - 2)
            if w > 2:
                left = np.nonzero(at > 0)[0]
                if left.size:
                    p = at[left]
                    ranks[left, p - 1] = self.ranks(parts[left, p - 1], parts[left, p])
                right = np.nonzero(at < w - 2)[0]
                if right.size:
                    p = at[right]
                    ranks[right, p] = self.ranks(parts[right, p], parts[right, p + 1])
        return out[out >= 0], counts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges by a heap over a linked list, for words too long to rescan."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = nxt[i]
            r = int(self.ranks(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r != NO_RANK:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [x for x in ids if x >= 0]

    # -- texts ------------------------------------------------------------------------------
    def _segments(self, texts: list[str | None]) -> tuple[list[str], list[tuple[int, list[int]]]]:
        """Texts in normal form; those that spell special tokens come apart: (text, its segments)."""
        flat: list[str] = []
        spelled: list[tuple[int, list[int]]] = []
        for i, t in enumerate(texts):
            t = t or ""
            marks = list(self.spelled.finditer(t)) if self.spelled else ()
            if marks:
                layout, at = [], 0
                for m in [*marks, None]:
                    if piece := t[at : m.start() if m else len(t)]:
                        layout.append(len(flat))
                        flat.append(self.normal(piece))
                    if m:
                        layout.append(-1 - self.special[m.group()])
                        at = m.end()
                spelled.append((i, layout))
            else:
                flat.append(self.normal(t))
        return flat, spelled

    def normal(self, text: str) -> str:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if max(text) >= chr(PLAIN) or "İ" in text:
                    return self.library.normalizer.normalize_str(text)
        return text.lower()

    def words(self, texts: list[str]) -> "Words":
        """Distinct words of normalised texts with their ids, and each text's words as codes."""
        hashes, begins, lengths, bases, per_text = [], [], [], [], np.zeros(len(texts), np.int64)
        long_words: dict[bytes, int] = {}
        bufs, base, i = [], 0, 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                size += len(texts[j])
                j += 1
            raw = [t.encode("utf-8", "replace") for t in texts[i:j]]
            buf = np.frombuffer(b"\n".join(raw) + b"\n" * 64, np.uint8)
            starts, sizes = self._split(buf)
            ends = np.cumsum([len(r) + 1 for r in raw])
            per_text[i:j] = np.diff(np.append(0, np.searchsorted(starts, ends)))
            short = sizes <= SHORT
            h = np.zeros(starts.size, np.uint64)
            h[short] = self._hash(buf, starts[short], sizes[short])
            for k in np.nonzero(~short)[0].tolist():
                w = buf[starts[k] : starts[k] + sizes[k]].tobytes()
                h[k] = long_words.setdefault(w, len(long_words))
            hashes.append(h)
            begins.append(starts + base)
            lengths.append(sizes)
            bufs.append(buf)
            base += buf.size
            i = j
        if not hashes:
            return Words(np.zeros(0, np.int64), per_text, np.zeros(0, np.int64), np.zeros(1, np.int64))
        buf = np.concatenate(bufs) if len(bufs) > 1 else bufs[0]
        starts, sizes, h = np.concatenate(begins), np.concatenate(lengths), np.concatenate(hashes)
        is_long = sizes > SHORT
        h = np.where(is_long, h | np.uint64(1 << 63), h & np.uint64((1 << 63) - 1))
        codes, _ = pd.factorize(h)
        codes = codes.astype(np.int64)
        n = int(codes.max()) + 1 if codes.size else 0
        first = np.empty(n, np.int64)
        first[codes[::-1]] = np.arange(codes.size - 1, -1, -1)
        codes, first = _told_apart(buf, starts, sizes, codes, first)
        n = first.size
        counts = np.zeros(n, np.int64)
        blocks, order = [], []
        lens = sizes[first] if n else np.zeros(0, np.int64)
        for width in np.unique(lens[lens <= SHORT]).tolist():
            own = np.nonzero(lens == width)[0]
            for a in range(0, own.size, 200_000):
                part = own[a : a + 200_000]
                flat, c = self.merge_block(buf[starts[first[part]][:, None] + np.arange(width)])
                blocks.append(flat)
                order.append(part)
                counts[part] = c
        for k in np.nonzero(lens > SHORT)[0].tolist():
            s = starts[first[k]]
            ids = np.array(self.merge_long(buf[s : s + lens[k]].tobytes()), np.int32)
            blocks.append(ids)
            order.append(np.array([k]))
            counts[k] = ids.size
        flat = np.concatenate(blocks) if blocks else np.zeros(0, np.int32)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        begin = np.zeros(n, np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return Words(codes, per_text, flat, counts, begin)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (one more than texts)."""
        flat, spelled = self._segments(texts)
        found = self.words(flat)
        ids, bounds = found.ids()
        if not spelled:
            return ids, bounds
        layouts, pieces, sizes, at = dict(spelled), [], [], 0
        for i in range(len(texts)):
            n = 0
            for s in layouts.get(i, [at]):
                piece = np.array([-1 - s], ids.dtype) if s < 0 else ids[bounds[s] : bounds[s + 1]]
                at += s >= 0
                n += piece.size
                pieces.append(piece)
            sizes.append(n)
        return np.concatenate(pieces), np.append(0, np.cumsum(sizes))

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens' own strings, set apart by blanks."""
        return " ".join(self.surface[i] for i in ids)

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: the number of ids, and the SHA-256 of its ids' and of its decoded text."""
        flat, spelled = self._segments(texts)
        w = self.words(flat)
        surface = [s.encode() + b" " for s in self.surface]
        number = [b"%d " % i for i in range(len(self.surface))]
        all_ids, begin, counts = w.flat.tolist(), w.begin.tolist(), w.counts.tolist()
        as_ids = [b"".join([number[i] for i in all_ids[b : b + c]]) for b, c in zip(begin, counts)]
        as_text = [b"".join([surface[i] for i in all_ids[b : b + c]]) for b, c in zip(begin, counts)]
        ends = np.cumsum(w.per_text)
        tokens = w.token_bounds()
        layouts, out, at = dict(spelled), [], 0
        for i in range(len(texts)):
            n, a, t = 0, [], []
            for s in layouts.get(i, [at]):
                if s < 0:
                    n += 1
                    a.append(number[-1 - s])
                    t.append(surface[-1 - s])
                    continue
                at += 1
                codes = w.codes[ends[s] - w.per_text[s] : ends[s]].tolist()
                n += int(tokens[s + 1] - tokens[s])
                a += [as_ids[c] for c in codes]
                t += [as_text[c] for c in codes]
            out.append((n, hashlib.sha256(b"".join(a)[:-1]).hexdigest(), hashlib.sha256(b"".join(t)[:-1]).hexdigest()))
        return out


class Words:
    """codes: distinct word of each occurrence; flat, begin, counts: the ids of distinct words."""

    def __init__(self, codes, per_text, flat, counts, begin=None):
        self.codes, self.per_text, self.flat, self.counts = codes, per_text, flat, counts
        self.begin = np.zeros(0, np.int64) if begin is None else begin

    def token_bounds(self) -> np.ndarray:
        words = np.append(0, np.cumsum(self.per_text))
        tokens = np.append(0, np.cumsum(self.counts[self.codes])) if self.codes.size else np.zeros(1, np.int64)
        return tokens[words]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        bounds = self.token_bounds()
        out = np.empty(int(bounds[-1]), np.uint16 if not self.flat.size or self.flat.max() < 65536 else np.int32)
        step, at = 1_000_000, 0
        for a in range(0, self.codes.size, step):
            c = self.codes[a : a + step]
            n = self.counts[c]
            total = int(n.sum())
            before = np.cumsum(n) - n
            out[at : at + total] = self.flat[np.repeat(self.begin[c] - before, n) + np.arange(total)]
            at += total
        return out, bounds


def _told_apart(buf, starts, sizes, codes, first):
    """Hash classes whose members differ in length or in either end are split by their bytes."""
    if not codes.size:
        return codes, first
    ends = starts + sizes
    differs = sizes != sizes[first][codes]
    head = _lanes(buf, starts, sizes)
    differs |= head != head[first][codes]
    more = np.nonzero(sizes > 8)[0]
    tail = np.zeros_like(head)
    tail[more] = _lanes(buf, ends[more] - 8, sizes[more])
    differs |= tail != tail[first][codes]
    for c in np.unique(codes[differs]).tolist():
        own: dict[bytes, int] = {}
        for k in np.nonzero(codes == c)[0].tolist():
            w = buf[starts[k] : ends[k]].tobytes()
            if w not in own:
                own[w] = c if not own else first.size
                if len(own) > 1:
                    first = np.append(first, k)
            codes[k] = own[w]
    return codes, first


def _lanes(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as one number, those past the size being zero."""
    view = np.ndarray((buf.size - 7,), "<u8", buf, strides=(1,))
    gone = np.maximum(8 - sizes, 0).astype(np.uint64) * np.uint64(8)
    return view[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> gone)


def _byte_alphabet() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others
    take code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(extra))
        extra += b not in printable
    return out


def digest_rows(docs, key: str = "doc_id", text: str = "text", vocabulary: str | None = None):
    """Each document's number of ids and the digests of its ids and of its decoded text."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from .common import slices

    def rows(batches):
        encoder = load(vocabulary)
        for batch in slices(batches, "text"):
            found = encoder.digests(batch.column("text").to_pylist())
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_rows(docs, key: str = "doc_id", text: str = "text", vocabulary: str | None = None):
    """Each document's ids."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from .common import slices

    def rows(batches):
        encoder = load(vocabulary)
        for batch in slices(batches, "text"):
            ids, bounds = encoder.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    plain = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(rows, "doc_id bigint, ids array<int>")


def decode_rows(tokens, ids: str = "ids", vocabulary: str | None = None):
    """Rows with ids, with their decoded text beside."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def rows(batches):
        encoder = load(vocabulary)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(rows, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))
