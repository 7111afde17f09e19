"""N-best SentencePiece segmentation: forward Viterbi, backward A*.

The scores of the model's pieces define a lattice over a text. The best score up
to every position, from a forward Viterbi pass, is an exact estimate of what a
path still needs when it is built from the end, so a backward A* search yields
segmentations in the order of their scores. No piece crosses from one word to
the next, so every word boundary lies on all paths: the search runs inside
words, is remembered for words seen before, and the segmentations of a text
combine those of its words. The forward pass takes the unseen words of many texts
together, one numpy step per position and piece length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
Path = tuple[float, tuple[int, ...]]
#: Ids and score of the best segmentation, what the second costs, and whether the ids decode to the word.
Word = tuple[tuple[int, ...], float, float, bool]


class Pieces:
    """Pieces, scores and bytes of a model file.

    A character that is no piece scores 10 below the worst ordinary piece and
    becomes its bytes. A literal U+2581 is such a character, so that decoding
    gives it back.
    """

    def __init__(self, model: str, best: int, remember: int = 500_000, longest: int = 64):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=model)
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes = [b""] * read.get_piece_size()
        self.byte_id = [read.unk_id()] * 256
        for i in range(read.get_piece_size()):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
                self.scores[piece.replace(BLANK, " ")] = (read.get_score(i), i)
                self.bytes[i] = piece.replace(BLANK, " ").encode()
                if " " in piece.replace(BLANK, " ").lstrip(" "):
                    raise ValueError(f"piece {piece!r} crosses a word boundary")
        self.width = max(map(len, self.scores))
        # runs of blanks and the like have a score of -1e9 that only forbids them
        self.unknown = min(s for s, _ in self.scores.values() if s > -1e8) - 10
        self.best, self.remember, self.longest = best, remember, longest
        self.known: dict[str, Word] = {}
        self.searched: dict[str, list[Path]] = {}
        # a line break or a literal U+2581 is part of no longer piece: it stands alone
        alone = "".join(c for c in "\n\t\r" + BLANK if not any(c in p for p in self.scores if len(p) > 1))
        self._grow()
        self.split = re.compile(f"[{alone}]| +[^ {alone}]*|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+")

    def _grow(self) -> None:
        """A tree over the pieces' characters: sorted keys ``node << 21 | character``, the next nodes, and the piece that ends in each node."""
        nodes, edges = {"": 0}, {}
        for piece in self.scores:
            for i in range(len(piece)):
                if piece[: i + 1] not in nodes:
                    nodes[piece[: i + 1]] = len(nodes)
                    edges[nodes[piece[:i]] << 21 | ord(piece[i])] = nodes[piece[: i + 1]]
        self.edges = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.ends = np.array([self.scores.get(p, (-np.inf, -1))[0] for p in nodes])
        self.piece = np.array([self.scores.get(p, (-np.inf, -1))[1] for p in nodes], np.int32)

    def learn(self, words: set[str], cells: int = 1 << 17) -> None:
        """Do what ``word`` does for all of these short words at once; ``cells`` characters with padding at a time."""
        new = sorted((w for w in words if w not in self.known and len(w) <= self.longest), key=len)
        if len(self.known) + len(new) > self.remember:
            # words in use stay, so that the frequent ones are not searched again and again
            self.known = {w: self.known[w] for w in words if w in self.known}
        while new:
            size = len(new[-1])
            # the longest first, so that words of about the same length are padded together
            take = max(1, cells // size)
            part, new = new[-take:], new[:-take]
            if len(part) > 16:
                self.known.update(zip(part, self._together(part, size)))

    def _together(self, words: list[str], size: int) -> Iterator[Word]:
        many, span = len(words), min(self.width, size)
        lengths = np.array([len(w) for w in words])
        beyond = 0x1FFFFF  # no character
        chars = np.full((many, size), beyond, np.int64)
        chars[np.arange(size) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.ascontiguousarray(chars.T).ravel()
        # [length - 1, begin, word]: score and id of the piece there
        scores = np.full((span, size, many), -np.inf)
        pieces = np.full((span, size, many), -1, np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for w in range(span):
            keep = at < (size - w) * many
            at, node = at[keep], node[keep]
            key = node << 21 | chars[at + w * many]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[place] == key
            at, node = at[hit], self.next[place[hit]]
            scores[w].reshape(-1)[at] = self.ends[node]
            pieces[w].reshape(-1)[at] = self.piece[node]
        lone = (pieces[0].reshape(-1) < 0) & (chars != beyond)
        scores[0].reshape(-1)[lone] = self.unknown
        ahead = np.full((size + 1, many), -np.inf)
        ahead[0] = 0
        back = np.zeros((size + 1, many), np.int64)
        for end in range(1, size + 1):
            for w in range(min(span, end), 0, -1):
                s = ahead[end - w] + scores[w - 1, end - w]
                better = s > ahead[end]
                np.copyto(ahead[end], s, where=better)
                back[end][better] = w
        every = np.arange(many)
        ids, count = np.zeros((many, size), np.int32), np.zeros(many, np.int64)
        taken = np.zeros(scores.shape, bool)
        end, rows = lengths.copy(), every
        while len(rows):
            w = back[end[rows], rows]
            begin = end[rows] - w
            ids[rows, count[rows]] = pieces[w - 1, begin, rows]
            taken[w - 1, begin, rows] = True
            count[rows] += 1
            end[rows] = begin
            rows = rows[begin > 0]
        behind = np.full((size + 1, many), -np.inf)
        behind[lengths, every] = 0
        second = np.full(many, -np.inf)
        for end in range(size, 0, -1):
            for w in range(1, min(span, end) + 1):
                s = scores[w - 1, end - w] + behind[end]
                np.maximum(behind[end - w], s, out=behind[end - w])
                s += ahead[end - w]
                s[taken[w - 1, end - w]] = -np.inf
                np.maximum(second, s, out=second)
        best = ahead[lengths, every]
        for word, found, n, score, more in zip(words, ids.tolist(), count.tolist(), best.tolist(), (best - second).tolist()):
            found = found[n - 1 :: -1] if n < len(found) else found[::-1]
            if -1 in found:
                found = self._spell(word, found)
            yield tuple(found), score, more, self.join(found) == word

    def _spell(self, word: str, ids: list[int]) -> list[int]:
        """Bytes for the characters that are no piece, marked by -1."""
        out, at = [], 0
        for i in ids:
            if i < 0:
                out += [self.byte_id[b] for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(i)
                at += len(self.bytes[i].decode())
        return out

    def search(self, word: str) -> list[Path]:
        """The best segmentations of one word, at most ``best``, best first."""
        n, get, push = len(word), self.scores.get, heapq.heappush
        ahead, into = [0.0], []
        for end in range(1, n + 1):
            own, top = [], -np.inf
            for begin in range(max(0, end - self.width), end):
                found = get(word[begin:end])
                if found:
                    own.append((begin, found[0], (found[1],)))
                    if ahead[begin] + found[0] > top:
                        top = ahead[begin] + found[0]
            if word[end - 1] not in self.scores:
                own.append((end - 1, self.unknown, tuple(self.byte_id[b] for b in word[end - 1].encode("utf-8", "surrogatepass"))))
                top = max(top, ahead[-1] + self.unknown)
            into.append(own)
            ahead.append(top)
        # (estimate, place, order of creation, score so far, ids so far as a chain)
        queue = [(-ahead[n], n, 0, 0.0, None)]
        made, found = 1, []
        while queue and len(found) < self.best:
            _, place, _, score, chain = heapq.heappop(queue)
            if not place:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                found.append((score, tuple(ids)))
                continue
            for begin, s, ids in into[place - 1]:
                push(queue, (-(ahead[begin] + score + s), begin, made, score + s, (ids, chain)))
                made += 1
        return found

    def word(self, word: str) -> Word:
        """The best segmentation of a word and the cost of the second, from memory if the word is short and was seen.

        Every other path has a piece that is not on the best one. So the second
        best is the best path through such a piece: what is best before it, the
        piece, and what is best after it.
        """
        known = self.known.get(word)
        if known is None:
            n, get, width, lowest = len(word), self.scores.get, self.width, float("-inf")
            ahead, back, edges = [0.0], [None], []
            for end in range(1, n + 1):
                top, at = lowest, None
                for begin in range(end - width if end > width else 0, end):
                    found = get(word[begin:end])
                    if found:
                        s = found[0]
                        edges.append((begin, end, s))
                        s += ahead[begin]
                        if s > top:
                            top, at = s, (begin, (found[1],))
                c = word[end - 1]
                if c not in self.scores:
                    edges.append((end - 1, end, self.unknown))
                    if ahead[-1] + self.unknown > top:
                        top, at = ahead[-1] + self.unknown, (end - 1, tuple(self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")))
                ahead.append(top)
                back.append(at)
            pieces, taken, end = [], set(), n
            while end:
                begin, ids = back[end]
                pieces.append(ids)
                taken.add((begin, end))
                end = begin
            ids = tuple(chain.from_iterable(reversed(pieces)))
            behind, second = [lowest] * n + [0.0], lowest
            for begin, end, s in reversed(edges):
                s += behind[end]
                if s > behind[begin]:
                    behind[begin] = s
                if ahead[begin] + s > second and (begin, end) not in taken:
                    second = ahead[begin] + s
            known = (ids, ahead[n], ahead[n] - second, self.join(ids) == word)
            if n <= self.longest and len(self.known) < self.remember:
                self.known[word] = known
        return known

    def others(self, word: str) -> list[Path]:
        """The best segmentations of a word but for the one that ``word`` gives."""
        found = self.searched.get(word)
        if found is None:
            best = self.word(word)[0]
            found = [p for p in self.search(word) if p[1] != best][: self.best - 1]
            if len(word) <= self.longest:
                if len(self.searched) >= self.remember // 4:
                    self.searched.clear()
                self.searched[word] = found
        return found

    def words(self, text: str) -> list[str]:
        return self.split.findall(" " + text) if text else []

    def nbest(self, text: str) -> tuple[list[Word], list[tuple[float, tuple[tuple[int, int], ...]]]]:
        """Words, and the best combinations: score and the words ``(place, choice)`` that differ from the best."""
        return self.combine(self.words(text))

    def combine(self, words: list[str]) -> tuple[list[Word], list[tuple[float, tuple[tuple[int, int], ...]]]]:
        """The same for a text that is already cut into words."""
        get, word = self.known.get, self.word
        choices = [get(w) or word(w) for w in words]
        if not choices:
            return [], []
        _, scores, more, _ = zip(*choices)
        total = sum(scores)
        # any of the best combinations changes only words whose first change is among the cheapest
        more = np.array(more)
        cheap = np.flatnonzero(more <= np.partition(more, min(self.best, len(more)) - 1)[min(self.best, len(more)) - 1])
        order = cheap[np.argsort(more[cheap], kind="stable")][: self.best - 1]
        order = order[np.isfinite(more[order])].tolist()
        paths = [[choices[i][:2][::-1], *self.others(words[i])] for i in order]
        queue, seen, out = [(0.0, ())], {()}, []
        while queue and len(out) < self.best:
            cost, changed = heapq.heappop(queue)
            out.append((total - cost, tuple((order[k], c) for k, c in changed)))
            for k in range(len(order)):
                now = dict(changed).get(k, 0)
                if now + 1 < len(paths[k]):
                    new = tuple(sorted({**dict(changed), k: now + 1}.items()))
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(queue, (cost + paths[k][now][0] - paths[k][now + 1][0], new))
        return choices, out

    def join(self, ids) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")

    def decode(self, ids) -> str:
        return self.join(ids)[1:]


_loaded: dict[tuple[str, int, int], Pieces] = {}


def pieces(model: str, best: int, remember: int = 500_000) -> Pieces:
    """The model of this worker process, read once."""
    if (model, best, remember) not in _loaded:
        _loaded[model, best, remember] = Pieces(model, best, remember)
    return _loaded[model, best, remember]


def encode(docs: DataFrame, model: str = MODEL, best: int = 4, alternatives: bool = True, remember: int = 500_000) -> DataFrame:
    """``doc_id, ids, scores, changes, decoded`` per row.

    ``ids`` is the best segmentation of the whole text. ``scores`` has the scores
    of the ``best`` best, falling; fewer if there are no more. ``changes`` says how
    each differs from the best: for every word that is cut otherwise, where its
    pieces begin in ``ids``, how many it replaces, and the new ones (null with
    ``alternatives=False``). ``decoded`` tells that decoding ``ids`` gives the text.
    ``remember`` words at most (about 600 bytes each) are kept by a worker process;
    fewer cost time, not results. Equal scores come in a fixed order. A null text gives nulls but for ``decoded``
    (true), an empty text no pieces and no scores. Equal rows get equal results;
    an empty table gives none; other columns are ignored.
    """
    schema = "doc_id long, ids array<int>, scores array<double>, changes array<array<struct<begin: int, size: int, ids: array<int>>>>, decoded boolean"
    kinds = {
        "ids": pa.list_(pa.int32()), "scores": pa.list_(pa.float64()),
        "changes": pa.list_(pa.list_(pa.struct({"begin": pa.int32(), "size": pa.int32(), "ids": pa.list_(pa.int32())}))), "decoded": pa.bool_(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model, best, remember)
        for part in slices(batches, "text"):
            rows: dict[str, list] = {k: [] for k in kinds}
            texts = part.column("text").to_pylist()
            cut = [known.words(text) if text else [] for text in texts]
            known.learn(set(chain.from_iterable(cut)))
            for text, words in zip(texts, cut):
                if text is None:
                    for k, v in (("ids", None), ("scores", None), ("changes", None), ("decoded", True)):
                        rows[k].append(v)
                    continue
                choices, found = known.combine(words)
                rows["ids"].append(np.array([*chain.from_iterable([c[0] for c in choices])], np.int32))
                rows["scores"].append([s for s, _ in found])
                # words follow each other without gaps, and each decodes to itself
                rows["decoded"].append(all([c[3] for c in choices]) and "".join(words) == (text and " " + text))
                if alternatives:
                    begins = np.cumsum([0, *[len(c[0]) for c in choices]])
                    rows["changes"].append(
                        [[{"begin": int(begins[w]), "size": len(choices[w][0]), "ids": known.others(words[w])[c - 1][1]} for w, c in changed] for _, changed in found]
                    )
                else:
                    rows["changes"].append(None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(rows[k], t) for k, t in kinds.items())], ["doc_id", *kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``ids``; null stays null, no pieces give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model, 1)
        for batch in batches:
            texts = [None if ids is None else known.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
