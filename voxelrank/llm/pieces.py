"""SentencePiece encoding and decoding with a streaming Viterbi pass.

The pass keeps a window of backpointers, maximises the sum of the pieces' scores, and commits ids
wherever all surviving paths go through one boundary (:class:`Stream`).  That is all a unigram
model needs.  The public vocabulary is of the BPE kind, whose merges no sum of scores gives; there
the lattice also forbids neighbours that the merge order would not leave side by side, and the path
that remains is the one the merges give, so the ids are those of the library for both kinds.

Ordinary text repeats its words, so each batch is cut where every path has a boundary, and only the
distinct parts are segmented.  These run through the same pass as arrays (:meth:`Codec.windows`): one
walk of the trie from all characters finds the boundaries where all paths meet, and the windows
between them advance together, one character at a step.  The texts' ids are gathered from the parts.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import tokenizer_path, whole_text

SPACE = "▁"
#: Cached segmentations of words (and a quarter of the verdicts on pairs); dropped when full.  Bytes of text in one go.
CACHE, SLICE = 500_000, 8 << 20
#: Characters of a window in the array pass at most; chunks segmented in one go; the sign between them.
LANE, AT_ONCE, APART = 64, 100_000, "\U0010ffff"
#: Classes of bytes between which a text is cut.
_OTHER, _SIGN, _SPACE = 0, 1, 2


class Codec:
    """Encoder and decoder over the pieces and scores of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_id, self.out = {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.out.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.out.append(b"")
            else:
                self.ids[piece] = i
                self.out.append(piece.replace(SPACE, " ").encode())
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that join words are not supported")
        if len(self.byte_id) < 256:
            raise ValueError("models without byte pieces are not supported")
        self.constrained = not _is_unigram(model.serialized_model_proto())
        self.unknown = min(self.score.values()) - 10.0
        self.trie: dict = {}
        for piece in self.ids:
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = piece
        self.letter_n = np.array(list(map(len, self.out)), np.int64)
        self.letter_at, self.letters = np.cumsum(self.letter_n) - self.letter_n, np.frombuffer(b"".join(self.out), np.uint8)
        # Merges of equal score (runs of space marks) share a rank: of two such, the one further left comes first.
        place = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in self.score.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        # Every path has a boundary where no piece joins the two classes: before a space mark that follows
        # another sign, between a letter and a sign apart, and after a sign apart unless it is a joiner.
        apart = {ch for ch in map(chr, range(1, 127)) if not ch.isalnum() and ch != " "}
        bonds = {(x, y) for p in self.ids for x, y in zip(p, p[1:]) if SPACE not in (x, y)}
        while bad := {y for x, y in bonds if y in apart and x not in apart}:
            apart -= bad
        self.kind, self.joins = np.full(256, _OTHER, np.uint8), np.zeros(256, bool)
        self.kind[[ord(c) for c in apart]], self.kind[ord(" ")] = _SIGN, _SPACE
        self.joins[[ord(x) for x, y in bonds if x in apart and y not in apart]] = True
        self.pairs: dict[tuple[str, str], bool] = {}
        self.widest = self.commits = 0
        self._tabulate()
        self._forget()

    def _tabulate(self) -> None:
        """The trie, the scores and the merges as arrays; pieces, and characters that only stand in pieces, by number."""
        names = [*self.ids, *sorted({ch for p in self.ids for ch in p} - self.ids.keys())]
        self.number, self.no_piece = {p: k for k, p in enumerate(names)}, len(names)
        self.id_of = np.array([*self.ids.values(), *[0] * (len(names) - len(self.ids) + 1)], np.uint32)
        self.score_of = np.array([*(self.score[p] for p in self.ids), *[self.unknown] * (len(names) - len(self.ids) + 1)])
        edges, node_piece, stack = [], [-1], [(self.trie, 0)]
        while stack:
            node, k = stack.pop()
            for ch, below in node.items():
                if ch:
                    edges.append((k << 21 | ord(ch), len(node_piece)))
                    stack.append((below, len(node_piece)))
                    node_piece.append(self.number[below[""]] if "" in below else -1)
        edges = np.array(sorted(edges), np.int64)
        self.edge_keys, self.edge_to, self.node_piece = edges[:, 0].copy(), edges[:, 1].copy(), np.array(node_piece)
        self.rank_of, self.half_left, self.half_right = (np.full(len(names) + 1, -1, np.int64) for _ in range(3))
        merges = []
        for piece in self.ids if self.constrained else ():
            if len(piece) > 1:
                left, right = self.split(piece)
                if left != piece and left in self.number and right in self.number:
                    k = self.number[piece]
                    self.rank_of[k], self.half_left[k], self.half_right[k] = self.rank[piece], self.number[left], self.number[right]
                merges += [(self.number[x] << 32 | self.number[y], self.rank[piece]) for x, y in ((piece[:i], piece[i:]) for i in range(1, len(piece))) if x in self.number and y in self.number]
        merges = np.array(sorted(merges) or [(-1, 0)], np.int64)
        self.merge_keys, self.merge_rank = merges[:, 0].copy(), merges[:, 1].copy()
        self.verdicts: dict[int, bool] = {}

    def split(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge gives ``piece``; a piece that no merge gives is its own parts."""
        found = self.halves.get(piece)
        if found is None:
            parts = list(piece)
            while len(parts) > 2:
                best = max(((self.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.score), default=None)
                if best is None:
                    break
                parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
            found = self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else (piece, piece)
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether merging the characters of ``a + b`` stops at exactly these two pieces.

        Walks back through the last merges of either side: the later one of the two is undone first,
        and a merge over the boundary that would have come before it forbids the pair.  Of merges of
        equal rank the left one comes first: it is undone last, a merge over the boundary comes before
        one of the right side and after one of the left side.
        """
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        rank, x, y, limit, fine = self.rank, a, b, 1 << 60, True
        while True:
            if (over := rank.get(x + y)) is not None and over < limit:
                fine = False
                break
            left, right = rank.get(x, -1) if len(x) > 1 else -1, rank.get(y, -1) if len(y) > 1 else -1
            if left < 0 and right < 0:
                break
            if left > right:
                limit, x = left, self.split(x)[1]
            else:
                limit, y = right + 1, self.split(y)[0]
        self.pairs[a, b] = fine
        return fine

    def stream(self) -> Stream:
        return Stream(self)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text in which spaces are space marks."""
        s = self.stream()
        return s.feed(text) + s.close()

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`follows` for many pairs of piece numbers."""
        rank, fine, x, y = self.rank_of, np.ones(len(a), bool), a.copy(), b.copy()
        limit, live = np.full(len(a), 1 << 60), np.arange(len(a))
        while len(live):
            key = x[live] << 32 | y[live]
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            bad = (self.merge_keys[at] == key) & (self.merge_rank[at] < limit[live])
            fine[live[bad]] = False
            live = live[~bad]
            left, right = rank[x[live]], rank[y[live]]
            more = (left >= 0) | (right >= 0)
            live, left, right = live[more], left[more], right[more]
            of_left = left > right
            i = live[of_left]
            limit[i], x[i] = left[of_left], self.half_right[x[i]]
            i = live[~of_left]
            limit[i], y[i] = right[~of_left] + 1, self.half_left[y[i]]
        return fine

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a may stand before pieces b; verdicts are kept."""
        key, back = np.unique(a << 32 | b, return_inverse=True)
        known = self.verdicts
        got = [known.get(k) for k in key.tolist()]
        if None in got:
            if len(known) > 4 * CACHE:
                known.clear()
            new = np.array([g is None for g in got])
            fine = self._side_by_side(key[new] >> 32, key[new] & 0xFFFFFFFF)
            known.update(zip(key[new].tolist(), fine.tolist()))
            out = np.array([bool(g) for g in got])
            out[new] = fine
            return out[back]
        return np.array(got, bool)[back]

    def _walk(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece of each length that ends at each character, or -1; how far pieces under way reach from each character)."""
        n = len(text)
        ends, reach = np.full((self.longest, n), -1, np.int32), np.arange(1, n + 1)
        live, node = np.arange(n), np.zeros(n, np.int64)
        for depth in range(1, self.longest + 1):
            inside = live + depth <= n
            live, node = live[inside], node[inside]
            key = node << 21 | text[live + depth - 1]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[at] == key
            live, node = live[hit], self.edge_to[at[hit]]
            if not len(live):
                break
            reach[live] = live + depth
            piece = self.node_piece[node]
            whole = piece >= 0
            ends[depth - 1, live[whole] + depth - 1] = piece[whole]
        ends[0, ends[0] < 0] = self.no_piece
        return ends, reach

    def windows(self, text: np.ndarray) -> np.ndarray:
        """For each character, the piece of the best path that ends there, or -1.

        All windows of the text advance together.  A window ends where no piece is under way: there all
        surviving paths go through one boundary, and what lies before is settled.  Windows of more than
        LANE characters go through a :class:`Stream` of their own, which also sees paths meet earlier.
        """
        n, ends_here = len(text), np.full(len(text), -1, np.int64)
        if not n:
            return ends_here
        ends, reach = self._walk(text)
        cut = np.r_[0, np.flatnonzero(np.maximum.accumulate(reach) <= np.arange(1, n + 1)) + 1]
        size = np.diff(cut)
        self.commits, self.widest = self.commits + len(size), max(self.widest, int(size.max(initial=0, where=size <= LANE)))
        for k in np.flatnonzero(size > LANE):
            stream, at = self.stream(), int(cut[k]) - 1
            word = "".join(map(chr, text[cut[k] : cut[k + 1]].tolist()))
            for piece in stream.feed(word) + stream.close():
                at += len(piece)
                ends_here[at] = self.number.get(piece, self.no_piece)
            self.commits, self.widest = self.commits + stream.commits, max(self.widest, stream.widest)
        short = np.flatnonzero(size <= LANE)
        short = short[np.argsort(-size[short], kind="stable")]
        start, size = cut[short], size[short]
        best, last, length = np.full(n, -np.inf), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for e in range(1, int(size[0]) + 1 if len(size) else 1):
            here = start[: np.searchsorted(-size, -e, "right")] + e - 1  # of the windows that are this long
            for many in range(min(e, self.longest), 0, -1):
                piece = ends[many - 1, here]
                at = here[piece >= 0]
                piece = piece[piece >= 0].astype(np.int64)
                total = self.score_of[piece]
                if many < e:
                    total = total + best[at - many]
                better = total > best[at]
                at, piece, total = at[better], piece[better], total[better]
                if many < e and self.constrained and len(at):
                    before = last[at - many]
                    plain = (before != self.no_piece) & (piece != self.no_piece)
                    fine = np.ones(len(at), bool)
                    fine[plain] = self._allowed(before[plain], piece[plain])
                    at, piece, total = at[fine], piece[fine], total[fine]
                best[at], last[at], length[at] = total, piece, many
        at, first = start + size - 1, start
        while len(at):
            if not length[at].all():
                raise ValueError("no path through the text")
            ends_here[at] = last[at]
            at = at - length[at]
            at, first = at[at >= first], first[at >= first]
        return ends_here

    def _coded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has).  A sign that is in no piece keeps them apart."""
        text = np.frombuffer(APART.join(c.decode() for c in chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        text[text == ord(" ")] = ord(SPACE)
        size = np.array([len(c.decode()) for c in chunks], np.int64)
        stop = np.cumsum(size + 1) - 1  # where the signs between chunks stand
        found = self.windows(text)
        found[stop[:-1]] = -1
        at = np.flatnonzero(found >= 0)
        piece = found[at]
        owner, n = np.searchsorted(stop, at, "right"), np.ones(len(at), np.int64)
        odd = piece == self.no_piece
        signs = text[at[odd]]
        raw = [chr(c).encode() for c in signs.tolist()]
        n[odd] = list(map(len, raw))
        ids = np.repeat(self.id_of[piece], n)
        ids[np.repeat(odd, n)] = [self.byte_id[b] for r in raw for b in r]
        return ids, np.bincount(owner, n, len(chunks)).astype(np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin): every distinct chunk of the batch is segmented once."""
        raw, ends = _bytes_of(texts)
        starts, size = ends[:-1], np.diff(ends)
        some = size > 0
        raw = np.insert(raw, starts[some], ord(" "))  # the space in front of each text
        ends = ends + np.r_[0, np.cumsum(some)]
        kind = self.kind[raw]
        a, b = kind[:-1], kind[1:]
        cut = np.r_[True, (b == _SPACE) & (a != _SPACE) | (b == _SIGN) & (a == _OTHER) | (b == _OTHER) & (a == _SIGN) & ~self.joins[raw[:-1]]][: len(raw)]
        cut[ends[:-1][some]] = True
        at = np.r_[np.flatnonzero(cut), len(raw)].astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        kinds = chunks.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self._forget()
        new = [c for c in kinds if c not in self.known]
        for lo in range(0, len(new), AT_ONCE):
            part = new[lo : lo + AT_ONCE]
            ids, n = self._coded(part)
            self.known.update(zip(part, range(len(self.count), len(self.count) + len(part))))
            self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, n])
        where = np.array([self.known[c] for c in kinds], np.int64)
        index = where[chunks.indices.to_numpy()]
        n = self.count[index]
        ids = self.flat[_ranges((np.cumsum(self.count) - self.count)[index], n)]
        before = np.r_[0, np.cumsum(n)]
        return ids, before[np.searchsorted(at, ends)]

    def _forget(self) -> None:
        self.known, self.flat, self.count = {}, np.empty(0, np.uint32), np.empty(0, np.int64)

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit bytes."""
        return self.encode_batch(pa.array([text]))[0].astype("<u4", copy=False).tobytes()

    def decode_batch(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """Bytes of the texts whose ids lie between the places ``begin``, with the space that encoding puts in front."""
        out = []
        for lo in range(0, len(begin) - 1, 4096):
            part = begin[lo : lo + 4097]
            own = ids[part[0] : part[-1]]
            held = []
            for at in range(0, len(own), 1 << 18):
                i = own[at : at + (1 << 18)]
                held.append(self.letters[_ranges(self.letter_at[i], self.letter_n[i])])
            raw = np.concatenate(held).tobytes() if held else b""
            where = np.r_[0, np.cumsum(self.letter_n[own])][part - part[0]].tolist()
            out += [raw[a:b] for a, b in zip(where, where[1:])]
        return out

    def decode(self, ids) -> str:
        """Text of ids; the space that encoding puts in front is taken away."""
        ids = np.asarray(ids, np.int64)
        text = self.decode_batch(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Stream:
    """Viterbi over a stream of characters, in a window of backpointers.

    ``best`` and ``back`` hold, for each boundary of the window, the greatest sum of scores of the
    pieces up to it and where the last of them begins.  A boundary at which a piece may still be under
    way, and the newest one, are survivors: all that follows goes through one of them.  Where their
    backpointer paths come together, the pieces before are committed and leave the window.
    """

    def __init__(self, codec: Codec):
        self.codec, self.widest, self.commits = codec, 0, 0
        self._reset(None)

    def _reset(self, last):
        self.text, self.best, self.back, self.last, self.open = "", [0.0], [-1], [last], []

    def feed(self, text: str) -> list[str]:
        """Pieces that are settled once ``text`` has come."""
        c, out = self.codec, []
        trie, score, constrained, pairs, follows, unknown = c.trie, c.score, c.constrained, c.pairs, c.follows, c.unknown
        for ch in text:
            end = len(self.text) + 1
            self.text += ch
            window, best, last = self.text, self.best, self.last
            top, origin, chosen, under = None, -1, None, []
            for start, node in [*self.open, (end - 1, trie)]:
                if best[start] is None or (node := node.get(ch)) is None:
                    continue
                under.append((start, node))
                if (piece := node.get("")) is not None:
                    total = best[start] + score[piece]
                    if top is None or total > top:
                        if constrained and (before := last[start]) is not None:
                            fits = pairs.get((before, piece))
                            if not (follows(before, piece) if fits is None else fits):
                                continue
                        top, origin, chosen = total, start, piece
            if best[end - 1] is not None and ch not in score:  # a character that is no piece goes by its bytes
                total = best[end - 1] + unknown
                if (top is None or total > top) and not (constrained and last[end - 1] is not None and not follows(last[end - 1], ch)):
                    top, origin, chosen = total, end - 1, ch
            best.append(top)
            self.back.append(origin)
            last.append(chosen)
            self.open = under
            self.widest = max(self.widest, len(window))
            if top is not None and (not under or under[0][0] or len(under) == 1):
                out += self._commit([end, *(s for s, _ in under)])
            elif not under:
                raise ValueError("no path through the text")
        return out

    def _commit(self, alive) -> list[str]:
        """Pieces up to the boundary through which the paths of all survivors go."""
        back, paths = self.back, set(alive)
        while len(paths) > 1:
            paths.remove(at := max(paths))
            paths.add(back[at] if back[at] >= 0 else 0)
        to = paths.pop()
        if to <= 0 or self.best[to] is None:
            return []
        out = self._trace(to)
        self.commits += 1
        low = self.best[to]
        self.text, self.last = self.text[to:], self.last[to:]
        self.best = [None if b is None else b - low for b in self.best[to:]]
        self.back = [b - to for b in self.back[to:]]
        self.open = [(s - to, node) for s, node in self.open]
        return out

    def _trace(self, at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(self.last[at])
            at = self.back[at]
        return out[::-1]

    def close(self) -> list[str]:
        """The rest; the stream starts anew."""
        if self.best[-1] is None:
            raise ValueError("no path through the text")
        out = self._trace(len(self.text))
        self._reset(None)
        return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start .. start + n - 1 of each pair, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of texts whose space marks are read as spaces."""
    texts = pc.replace_substring(texts, SPACE, " ").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def _is_unigram(proto: bytes) -> bool:
    """Whether the model file's type (field 3 of its field 2) is the default, a unigram model."""

    def fields(data):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
                if byte < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, data[at : at + size]
                at += size

    trainer = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1) == 1


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _slices(batches):
    """(ids, texts) of a few texts at a time; a longer text comes alone."""
    for b in batches:
        size, lo = np.cumsum([0, *pc.binary_length(b.column(1)).to_pylist()]), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SLICE, "right")) - 1)
            yield b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
            lo = hi


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, text`` (the text passed through) for each row.

    Null text is empty and has no ids; ids of rows may be null or repeat; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored; a text of any length is held
    by one task.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        c = codec(path)
        for ids, texts in _slices(batches):
            coded, begin = c.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(coded.view(np.int32))), texts], names=["doc_id", "ids", "text"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text, decoded``: the ids of each row turned back into text, as :func:`encode` returns them.

    No ids give empty text, null ids null; rows may repeat and ids of rows be null; bytes that are no
    UTF-8 become replacement signs; an empty table gives no rows; other columns are ignored.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = batch.column("ids")
            begin = np.r_[0, np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            texts = [t.decode("utf-8", "replace").removeprefix(" ") for t in c.decode_batch(ids.flatten().to_numpy(zero_copy_only=False), begin)]
            texts = [t if known else None for t, known in zip(texts, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return coded.select("doc_id", "ids", "text").mapInArrow(run, "doc_id long, ids array<int>, text string, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids_crc32, n_chars, round_trip`` for each row, through encoding and decoding.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers.  ``round_trip`` compares
    with the text in which the space mark itself reads as a space, as the format does not tell the
    two apart.  Null and awkward rows are as in :func:`encode`.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    names, kinds = ["doc_id", "n_ids", "ids_crc32", "n_chars", "round_trip"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches):
        c = codec(path)
        for doc_ids, texts in _slices(batches):
            ids, begin = c.encode_batch(texts)
            raw, ends = _bytes_of(texts)
            raw, place, same, crc = raw.tobytes(), begin.tolist(), [], []
            for k, back in enumerate(c.decode_batch(ids, begin)):
                text = raw[ends[k] : ends[k + 1]]
                same.append(back == b" " + text if text else not back)
                crc.append(zlib.crc32(ids[place[k] : place[k + 1]].astype("<u4", copy=False).tobytes()))
            cols = (doc_ids, np.diff(begin), crc, pc.utf8_length(texts).cast(pa.int64()), same)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, round_trip boolean")
