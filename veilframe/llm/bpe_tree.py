"""BPE encoding and decoding by tree concatenation.

Every text is a tree: halved again and again until a half has at most `leaf` characters, wherever that cuts it. All
leaves of a batch of texts are encoded at once, and the encodings are joined pairwise up the trees, level by
level. At a join the text around it is encoded once more, in a window that grows until several tokens of
either side, at some distance from the window's ends, are the window's tokens at the same places; then
left + middle + right is the encoding of the whole. A window that has grown over a side replaces it, so the result
is exact where the sides never agree, too, as in one letter repeated without end.

Leaves are split at their white space, where neither tokenizer of this repository lets a token go on, and
each distinct word of a leaf is encoded by the library once per worker and remembered, with the places of its tokens
(a bounded table of words that a leaf bounds). Leaves with the text of a special token are encoded whole.

Null texts encode like empty ones, to no tokens; repeated rows are encoded one by one; an empty table
gives an empty result; other columns are ignored. The tokenizer's file is a parameter; executors read it once per
worker, from the bytes they are sent."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from veilframe.llm.bytesig import BLANK, spans
from veilframe.llm.common import mapped, pieces, utf8

_LOADED: dict[str, Tokenizer] = {}


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def load(data: bytes) -> Tokenizer:
    """The tokenizer of a file's bytes, without truncation and padding; kept for the worker's life."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; see threads() for the exception
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        made = Tokenizer.from_buffer(data)
        made.no_truncation()
        made.no_padding()
        _LOADED[key] = made
    return _LOADED[key]


class Run:
    """Tokens of text[start:stop]: ids, and the place in the text where each begins."""

    __slots__ = ("ids", "begin", "start", "stop")

    def __init__(self, ids: np.ndarray, begin: np.ndarray, start: int, stop: int):
        self.ids, self.begin, self.start, self.stop = ids, begin, start, stop


def encoded(tokenizer: Tokenizer, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and places of each part's tokens, by the library."""
    out = []
    for e in tokenizer.encode_batch(parts, add_special_tokens=False):
        out.append((np.array(e.ids, np.uint32), np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]))
    return out


def halves(start: int, stop: int, leaf: int) -> list[tuple[int, int]]:
    if stop - start <= leaf:
        return [(start, stop)]
    middle = (start + stop) // 2
    return halves(start, middle, leaf) + halves(middle, stop, leaf)


#: How far a window's end is moved to white space, and how many characters beside it don't count for agreement.
SLACK, MARGIN = 32, 12


def window_of(text: str, left: Run, right: Run, size: int) -> tuple[int, int]:
    """The bounds of a window of about `size` characters on either side of the join."""
    a, b = left.stop - size, left.stop + size
    if a - SLACK <= left.start:
        a = left.start
    else:
        a = max(text.rfind(" ", a - SLACK, a), text.rfind("\n", a - SLACK, a), a - 1) + 1
        while a > left.start and unicodedata.combining(text[a]):
            a -= 1
    if b + SLACK >= right.stop:
        b = right.stop
    else:
        at = text.find(" ", b, b + SLACK)
        b = at if at >= 0 else b
        while b < right.stop and unicodedata.combining(text[b]):
            b += 1
    return a, b


def joined(left: Run, right: Run, a: int, b: int, ids: np.ndarray, begin: np.ndarray, agree: int) -> Run | None:
    """The encoding of both sides, given that of the window from a to b; None where a side doesn't agree with it.

    A side agrees if `agree` of its tokens that lie between the window's end and the join are the window's, too, at
    the same places: then each two neighbours among the result's tokens were neighbours in one encoding."""
    seam = left.stop
    i, p = 0, 0
    if a > left.start:
        i = int(np.searchsorted(left.begin, a + MARGIN))
        p = int(np.searchsorted(begin, a + MARGIN))
        if i + agree > len(left.ids) or left.begin[i + agree - 1] >= seam or not same(left, i, ids, begin, p, agree):
            return None
    j, q = len(right.ids), len(ids)
    if b < right.stop:
        last = int(np.searchsorted(right.begin, b - MARGIN)) - agree
        if last < 0:
            return None
        j = int(np.searchsorted(right.begin, right.begin[last]))  # the first token of its character
        q = int(np.searchsorted(begin, right.begin[last]))
        if not same(right, j, ids, begin, q, agree):
            return None
    return Run(np.concatenate([left.ids[:i], ids[p:q], right.ids[j:]]), np.concatenate([left.begin[:i], begin[p:q], right.begin[j:]]), left.start, right.stop)


def same(run: Run, i: int, ids: np.ndarray, begin: np.ndarray, p: int, n: int) -> bool:
    return np.array_equal(run.ids[i : i + n], ids[p : p + n]) and np.array_equal(run.begin[i : i + n], begin[p : p + n])


@contextlib.contextmanager
def threads(wanted: bool):
    """The library's batches in several threads, where a long text gives them enough to do."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if wanted else "false"
    try:
        yield
    finally:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"


def encode_trees(tokenizer: Tokenizer, texts: list[str], leaf: int, leaves, window: int = 96, agree: int = 6) -> list[np.ndarray]:
    """Token ids of each text: halves of at most `leaf` characters, joined level by level for all texts at once.

    leaves(parts) gives the ids and places of the tokens of each leaf."""
    cuts = [halves(0, len(t), leaf) for t in texts]
    parts = [t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in c]
    with threads(len(parts) > 256):
        found = iter(leaves(parts))
    level = [[Run(ids, begin + a, a, b) for (a, b), (ids, begin) in zip(c, found, strict=False)] for c in cuts]
    while any(len(runs) > 1 for runs in level):
        made: list[list] = [[None] * ((len(runs) + 1) // 2) for runs in level]
        open_ = []
        for k, runs in enumerate(level):
            if len(runs) % 2:
                made[k][-1] = runs[-1]
            open_ += [(k, i) for i in range(len(runs) // 2)]
        size = window
        while open_:
            bounds = [window_of(texts[k], level[k][2 * i], level[k][2 * i + 1], size) for k, i in open_]
            with threads(len(open_) > 256):
                middles = encoded(tokenizer, [texts[k][a:b] for (k, _), (a, b) in zip(open_, bounds, strict=True)])
            for (k, i), (a, b), (ids, begin) in zip(open_, bounds, middles, strict=True):
                made[k][i] = joined(level[k][2 * i], level[k][2 * i + 1], a, b, ids, begin + a, agree)
            open_ = [(k, i) for k, i in open_ if made[k][i] is None]
            size *= 2
        level = made
    return [runs[0].ids for runs in level]


def encode_tree(tokenizer: Tokenizer, text: str, leaf: int = 1 << 11, window: int = 96, agree: int = 6) -> np.ndarray:
    return encode_trees(tokenizer, [text], leaf, lambda parts: encoded(tokenizer, parts), window, agree)[0]


#: White space that is neither a space nor a newline.
OTHER_SPACE = re.compile(r"[^\S \n]")
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
MARK[0x21:0x30] = MARK[0x3A:0x41] = MARK[0x5B:0x61] = MARK[0x7B:0x7F] = True
CONTROLS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


class Memo:
    """Encodes texts by the library, each distinct word between white space once.

    A tokenizer that drops white space encodes each word alone; a byte-level one, whose words carry the space
    before them, encodes " word". Which of them it is, is tried out. `most` bounds the remembered words; with
    `placed`, which only the first kind has, the places of their tokens are remembered, too."""

    def __init__(self, tokenizer: Tokenizer, most: int = 200_000, run: int = 400, placed: bool = False):
        self.tokenizer, self.most, self.run = tokenizer, most, run
        # stretches after a space and others, each with those of the generation before
        self.known: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.tails_before: dict[str, bytes] = {}
        ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.drops = ids(" ab  cd\n") == ids("ab") + ids("cd")
        self.placed = placed and self.drops
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # tokens that begin with a space begin a word
        self.opens = np.array([(tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(tokenizer.get_vocab_size() + 1)])

    def plain(self, text: str) -> bool:
        """Whether the text's white space and marks surely bound its tokens."""
        if any(x in text for x in self.special):
            return False
        if self.drops:
            return True
        if any(x in text for x in ("  ", "\n\n", "\n ", " \n", *CONTROLS)) or text[:1] in (" ", "\n", "") or text[-1] in (" ", "\n"):
            return False
        return text.isascii() or not OTHER_SPACE.search(text)

    def learn(self, new: list[str]) -> None:
        """Encodes words in runs of many, joined by spaces, and deals the tokens out to them."""
        parts = [new[i : i + self.run] for i in range(0, len(new), self.run)]
        texts = [" " + " ".join(p) for p in parts]
        encode_batch = self.tokenizer.encode_batch if self.drops else self.tokenizer.encode_batch_fast
        for part, text, e in zip(parts, texts, encode_batch(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            edge = np.append(np.flatnonzero(self.opens[ids]), len(ids)) if not self.drops else None
            if edge is None or len(edge) != len(part) + 1:
                if not self.drops:
                    e = self.tokenizer.encode(text, add_special_tokens=False)
                starts = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
                edge = np.append(0, np.searchsorted(starts, np.cumsum([len(w) + 1 for w in part]), "left"))
            if self.placed:  # a word's ids, then the places of its tokens
                first = np.cumsum([0] + [len(w) + 1 for w in part])[:-1] + 1
                places = (starts - np.repeat(first, np.diff(edge))).astype(np.uint32)
                self.known.update((w, ids[x:y].tobytes() + places[x:y].tobytes()) for w, x, y in zip(part, edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                continue
            data, edge = ids.tobytes(), (edge * 4).tolist()
            self.known.update(zip(part, [data[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list = [None] * len(texts)
        split = [i for i, t in enumerate(texts) if self.plain(t)]
        whole = [i for i in range(len(texts)) if i not in set(split)] if len(split) < len(texts) else []
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        for i, (ids, _) in zip(split, self.assembled([texts[i] for i in split], False), strict=True):
            out[i] = ids
        return out

    def encode_placed(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token ids of each text, and where each token begins."""
        out: list = [None] * len(texts)
        split = [i for i, t in enumerate(texts) if self.placed and self.plain(t)]
        whole = [i for i in range(len(texts)) if i not in set(split)] if len(split) < len(texts) else []
        for i, found in zip(whole, encoded(self.tokenizer, [texts[i] for i in whole]), strict=True):
            out[i] = found
        for i, found in zip(split, self.assembled([texts[i] for i in split], True), strict=True):
            out[i] = found
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """The texts' words: their bytes end to end, the bounds of each, the bounds of each text's words among them, and the
        character of its text that each word begins at (where white space may be of any length)."""
        column = pa.array(texts, pa.string())
        if not self.drops:
            lists = pc.split_pattern(column, " ")
            edges = lists.offsets.to_numpy().astype(np.int64)
            words = lists.values.slice(edges[0], edges[-1] - edges[0])
            offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
            data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if words.buffers()[2] else np.empty(0, np.uint8)
            return data, offsets - offsets[0], edges - edges[0], None
        data, offsets = utf8(column)
        starts, ends, rows = spans(data, offsets, ~BLANK)
        edges = np.searchsorted(rows, np.arange(len(texts) + 1))
        if len(data) and data.max() > 0x7F:
            chars = np.cumsum((data & 0xC0) != 0x80)  # up to and with each byte
            before = np.append(0, chars)[offsets[rows]]
            at = chars[starts] - 1 - before
        else:
            at = starts - offsets[rows]
        bounds = np.append(0, np.cumsum(ends - starts))
        return data[~BLANK[data]], bounds, edges, at

    def assembled(self, texts: list[str], places: bool) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """The ids of the texts, and with `places` where the tokens begin: those of distinct stretches, dealt out by number.

        A word is cut once more where an ASCII letter meets ASCII punctuation, a place that both tokenizers'
        patterns always split at, so that a word isn't learned anew with each mark that may follow it."""
        if not texts:
            return []
        data, offsets, edges, begins = self.words(texts)
        if not len(data):
            return [(np.empty(0, np.uint32), np.empty(0, np.int64))] * len(texts)
        cut = np.zeros(len(data), bool)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        spaced = cut.copy()
        spaced[offsets[edges[:-1]][offsets[edges[:-1]] < len(data)]] = False  # a text's first word has no space before it
        cut[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
        starts = np.flatnonzero(cut)
        ends = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        if len(self.known) + len(self.tails) > self.most // 2:  # what is still in use comes back from the generation before
            self.known_before, self.tails_before, self.known, self.tails = self.known, self.tails, {"": b""}, {}
        if self.drops:
            pieces_, numbers = self.coded(parts, self.known, self.known_before, self.learn)
        else:
            mask = spaced[starts]
            pieces_, inner = self.coded(parts.filter(pa.array(mask)), self.known, self.known_before, self.learn)
            more, outer = self.coded(parts.filter(pa.array(~mask)), self.tails, self.tails_before, self.learn_bare)
            numbers = np.empty(len(starts), np.int64)
            numbers[mask], numbers[~mask] = inner, outer + len(pieces_)
            pieces_ += more
        sizes = np.fromiter(map(len, pieces_), np.int64, len(pieces_)) // (8 if self.placed else 4)
        flat = np.frombuffer(b"".join(pieces_), np.uint32)
        first = np.cumsum(sizes) - sizes
        length = sizes[numbers]
        at = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat((first * 2 if self.placed else first)[numbers] - at[:-1], length) + np.arange(at[-1])
        ids = flat[place]
        bounds = at[np.searchsorted(starts, offsets[edges])]
        if not places:
            return [(ids[x:y], None) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        # a stretch begins in its word, in characters: all of the word before it is counted
        word = np.searchsorted(offsets, starts, "right") - 1
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        origin = begins[word] + chars[starts] - chars[offsets[word]]
        where = flat[place + np.repeat(sizes[numbers], length)].astype(np.int64) + np.repeat(origin, length)
        return [(ids[x:y], where[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    @staticmethod
    def coded(parts: pa.Array, known: dict[str, bytes], before: dict[str, bytes], learn) -> tuple[list[bytes], np.ndarray]:
        """The ids of the distinct strings, and which of them each string is."""
        found = parts.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in distinct if w not in known]:
            known.update({w: before[w] for w in new if w in before})
            learn([w for w in new if w not in before])
        return [known[w] for w in distinct], found.indices.to_numpy().astype(np.int64)

    def learn_bare(self, new: list[str]) -> None:
        """Encodes stretches that no space stands before, one by one."""
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.tails[w] = np.array(e.ids, np.uint32).tobytes()


_MEMOS: dict[tuple[int, bool], Memo] = {}


def memo(tokenizer: Tokenizer, most: int = 200_000, placed: bool = False) -> Memo:
    key = id(tokenizer), placed
    if key not in _MEMOS:
        _MEMOS[key] = Memo(tokenizer, most, placed=placed)
    return _MEMOS[key]


def encode(tokenizer: Tokenizer, texts: list[str], leaf: int = 1 << 11, words: int = 200_000) -> list[np.ndarray]:
    """Token ids of each text. A text of at most `leaf` characters is a tree of one leaf. words: how many are remembered."""
    return encode_trees(tokenizer, texts, leaf, memo(tokenizer, words, placed=True).encode_placed)


TOKENS = "doc_id long, ids array<int>"


def tokens(docs: DataFrame, path: str, leaf: int = 1 << 11) -> DataFrame:
    """doc_id and the token ids of each row's text."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(path))

    def run(batches):
        tokenizer = load(sent.value)
        for batch in pieces(batches, "text", 1 << 20):
            ids = encode(tokenizer, [t or "" for t in batch.column("text").to_pylist()], leaf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return mapped(docs.select("doc_id", "text"), run, TOKENS)


def round_trip(docs: DataFrame, path: str, leaf: int = 1 << 11, keep: list[str] | None = None, words: int = 200_000) -> DataFrame:
    """One row per row of docs: the columns `keep` of docs (doc_id if not given), n_tokens,
    ids_sha256, decoded_sha256."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(path))
    kept = keep or ["doc_id"]

    def run(batches):
        tokenizer = load(sent.value)
        decimal = [str(i) for i in range(tokenizer.get_vocab_size() + 1)]
        for batch in pieces(batches, "text", 1 << 20):
            ids = [x.tolist() for x in encode(tokenizer, [t or "" for t in batch.column("text").to_pylist()], leaf, words)]
            texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([digest(" ".join([decimal[i] for i in x])) for x in ids]), pa.array([digest(t) for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(*kept, *([] if "text" in kept else ["text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return mapped(source, run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")
