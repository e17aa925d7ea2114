r"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 9).

A text is read character by character. What is kept is a window of boundaries
from which a piece may still end at a later character, at most as many as the
longest piece has characters, and the backpointer paths that lead to them.
Whenever all surviving paths pass one boundary, the ids up to it are committed
and everything before it is forgotten; paths that no boundary of the window
needs any more are dropped at once, so both take constant time a character.

Two kinds of model share the search:

* unigram: the pieces' log-probabilities are summed, the best sum survives;
* BPE: a path survives where each two neighbouring pieces stay apart when their
  joint text is merged on its own. Merging a text gives the one sequence of pieces
  with that property (a merge across a boundary depends on nothing but the two
  pieces at it), so each boundary has exactly one backpointer, and the ids are
  those of the library's merges. Which pieces stay apart is found once a pair.

``Codec`` applies the search to blocks of many texts at once. Where two characters
stand side by side in no piece at all, all paths meet between them: there the ids
are committed. Equal stretches between such places share one search. Those not
met before move through it side by side, one character a step, in numpy, after a
finer cut at the boundaries that no piece found in them passes over. A stretch of
over ``LANE`` characters after that goes through ``StreamingViterbi``, whose window
is the longest piece; its paths also meet in boundaries that pieces pass.
Stretches are told apart by a 64-bit hash; should two agree in it, the text would
not decode to itself, and ``encode_documents`` encodes it again without sharing.

Characters without a piece become byte pieces where the model has them (the
unknown id otherwise). Encoding puts the word mark for spaces and before the
text, as the model says; decoding undoes that, bytes included, so
decode(encode(text)) is the text, also where it holds the mark itself (as byte
pieces; the library reads it as a space, and so does a model without bytes).

Nulls and odd rows: a null or empty text has no ids; rows are independent, so
rows that repeat agree; the kept columns pass as they are, nulls too, and other
columns are not read. Kept columns may not be named ids, n_tokens or round_trip:
``encode_documents`` raises ValueError. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import table

MODEL, MARK = "/opt/tokenizers/piece_bpe_32k.model", "▁"
#: Characters of a block, rows of a table that are worked on at a time, the longest stretch searched beside others,
#: pairs of pieces whose merging and stretches whose ids are remembered.
BLOCK, ROWS, LANE, PAIRS, STRETCHES = 1 << 18, 256, 128, 1_000_000, 1_000_000
#: Stands for a word mark that the text itself holds; no text from a table has a lone surrogate.
LITERAL = "\udfff"
#: Scores are whole numbers of 1 / UNIT, so that sums do not depend on where a window starts; of equal paths the
#: one with the longest last piece wins.
UNIT = 1 << 24
#: What stands for a piece: the text's start, an unknown character, none yet; and the score of a boundary no path has come to.
START, UNKNOWN, NONE, NEVER = -1, -2, -3, -(1 << 62)
#: Characters that are fed at a time.
CHUNK = 4_096


def read_model(path: str) -> dict:
    """The model's pieces {text: (id, score)} and their tree, byte pieces {value: id}, the id for the unknown, and its kind."""
    from pathlib import Path

    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    return model_of([(p.piece, p.score, p.type) for p in proto.pieces], merges=proto.trainer_spec.model_type == 2, prefix=proto.normalizer_spec.add_dummy_prefix)


def model_of(listed: list[tuple[str, float, int]], *, merges: bool, prefix: bool) -> dict:
    """The same from (text, score, type) of each piece in order of ids; types are the model format's (1 and 4 ordinary, 2 unknown, 6 byte)."""
    pieces, raw, unknown = {}, {}, 0
    for i, (text, score, kind) in enumerate(listed):
        if kind == 6:
            raw[int(text[3:5], 16)] = i
        elif kind == 2:
            unknown = i
        elif kind in (1, 4):
            pieces[text] = (i, round(score * UNIT))
    tree: dict = {}  # character to (what may follow, id, score); id is None inside a longer piece only
    for text in sorted(pieces):
        below = tree
        for ch in text[:-1]:
            below = below.setdefault(ch, ({}, None, 0))[0]
        below[text[-1]] = ({}, *pieces[text])
    nodes, at = [(tree, None, 0)], 0  # breadth first: node 0 is the root
    edges: list[tuple[int, str, int]] = []
    while at < len(nodes):
        for ch, step in nodes[at][0].items():
            edges.append((at, ch, len(nodes)))
            nodes.append(step)
        at += 1
    return {
        "edges": edges, "node_piece": [-1 if w is None else w for _, w, _ in nodes], "node_score": [x for *_, x in nodes],
        # a character that only longer pieces hold may stand between pieces that merge across it
        "odd": any(ch not in pieces for p in pieces for ch in p),
        "pieces": pieces, "bytes": raw if len(raw) == 256 else {}, "unknown": unknown, "least": min((s for _, s in pieces.values()), default=0), "tree": tree,
        "merges": merges, "prefix": prefix, "longest": max(map(len, pieces), default=1),
        "names": [text for text, *_ in listed], "kinds": [kind for *_, kind in listed],
        "plain": {i: text.replace(MARK, " ") for i, (text, _, kind) in enumerate(listed) if kind in (1, 4)},
    }


class StreamingViterbi:
    """Feeds characters in, gives ids out as soon as they are certain."""

    def __init__(self, model: dict):
        self.model, self.names, self.longest = model, model["names"], model["longest"]
        #: The library scores an unknown character 10 below the worst piece.
        self.unknown = model["least"] - 10 * UNIT
        self.apart: dict[int, bool] = {}
        self.fed = self.widest = 0  # characters so far, of all texts, and the widest window of them
        self.reset()

    def reset(self) -> None:
        self.text = ""  # from the root, the last boundary that is certain
        self.at = 0  # the boundary from which pieces are tried next
        self.far = 0  # the farthest boundary to which a piece leads
        self.due = self.longest  # where paths are next compared
        self.best, self.back, self.what = [0], [0], [START]  # of each boundary: score, where its last piece starts, and which it is
        self.after_unknown = False

    def feed(self, chars: str) -> list[int]:
        self.fed += len(chars)
        self.text += chars
        return self._advance(len(self.text) - self.longest)

    def finish(self) -> list[int]:
        out = self._advance(len(self.text))
        self._say(0, self.at, out)
        self.reset()
        return out

    def encode(self, marked: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(marked), CHUNK):
            out += self.feed(marked[at : at + CHUNK])
        return out + self.finish()

    def _advance(self, limit: int) -> list[int]:
        """Tries the pieces that start at each boundary before ``limit`` of the text from the root."""
        text, tree, longest, apart, merges, unknown = self.text, self.model["tree"], self.longest, self.apart, self.model["merges"], self.unknown
        best, back, what, far, due, root, s = self.best, self.back, self.what, self.far, self.due, 0, self.at
        out: list[int] = []
        grow = limit + longest + 1 - len(what)
        if grow > 0:
            best += [NEVER] * grow
            back += [0] * grow
            what += [None] * grow
        while s < limit:
            if far == s and s > root:  # no path passes over this boundary
                self._commit(root, s, out)
                root, due = s, s + longest
            elif s >= due:
                meet = self._meeting(s, far)
                if meet > root:
                    self._commit(root, meet, out)
                    root = meet
                due = s + max(longest, s - root)  # looks at longer and longer paths stay linear together
            e, below, prior, here = s, tree, what[s], best[s]
            for ch in text[s : s + longest]:
                step = below.get(ch)
                if step is None:
                    break
                below, piece, score = step
                e += 1
                if piece is None:
                    continue
                if merges:
                    if what[e] is None:
                        key = prior << 24 | piece
                        ok = apart.get(key)
                        if ok is None or prior == UNKNOWN:
                            ok = self.stay_apart(key, text[s - 1] if prior == UNKNOWN else self.names[prior] if prior >= 0 else "", self.names[piece])
                        if ok:
                            back[e], what[e] = s, piece
                elif here + score > best[e]:
                    best[e], back[e], what[e] = here + score, s, piece
            s += 1
            if what[s] is None or (not merges and here + unknown > best[s]):
                best[s], back[s], what[s] = here + unknown, s - 1, UNKNOWN
            if e > far or s > far:
                far = max(e, s)
                self.widest = max(self.widest, far - s + 1)
        self.text, self.best, self.what = text[root:], best[root : far + 1], what[root : far + 1]
        self.back = [b - root for b in back[root : far + 1]]
        self.at, self.far, self.due = s - root, far - root, due - root
        return out

    def _meeting(self, s: int, far: int) -> int:
        """The boundary in which the paths to all boundaries from s on meet."""
        back = self.back
        ends = {e for e in range(s, far + 1) if self.what[e] is not None}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(back[last])
        return ends.pop()

    def _commit(self, root: int, end: int, out: list[int]) -> None:
        self._say(root, end, out)
        self.back[end] = end

    def _say(self, root: int, end: int, out: list[int]) -> None:
        """Adds the ids on the path from the root to a boundary."""
        what, back, path = self.what, self.back, []
        while end > root:
            path.append(end)
            end = back[end]
        for e in reversed(path):
            if what[e] >= 0:
                out.append(what[e])
                self.after_unknown = False
                continue
            if self.model["bytes"]:
                raw = self.text[e - 1].replace(LITERAL, MARK).encode("utf-8", "surrogatepass")
                out += [self.model["bytes"][x] for x in raw]
            elif not self.after_unknown:  # the library joins unknown characters that touch
                out.append(self.model["unknown"])
            self.after_unknown = True

    def stay_apart(self, key: int, a: str, b: str) -> bool:
        """Whether a, merged with b after it, is these two pieces again (b alone, for an empty a)."""
        pieces = self.model["pieces"]
        across = not a or any(a[i:] + b[:j] in pieces for i in range(len(a)) for j in range(1, len(b) + 1))  # else no merge can join them
        ok = not across or merged(a + b, pieces) == ([a, b] if a else [b])
        if key >> 24 != UNKNOWN:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            self.apart[key] = ok
        return ok


def merged(text: str, pieces: dict) -> list[str]:
    """The pieces of a short text: the best-scored neighbours are joined first, leftmost of equals."""
    parts = list(text)
    scores = [pieces.get(a + b, (0, None))[1] for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        top, at = None, -1
        for i, s in enumerate(scores):
            if s is not None and (top is None or s > top):
                top, at = s, i
        if top is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        for i in (at - 1, at):
            if 0 <= i < len(scores):
                scores[i] = pieces.get(parts[i] + parts[i + 1], (0, None))[1]


class NumberMap:
    """A hash map of whole numbers as arrays: get() of many keys at a time, -1 for those that are missing."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.int64).min), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], -1)
        more = np.flatnonzero(~hit & (found != np.iinfo(np.int64).min))
        while len(more):
            slot = (slot[more] + 1) & (len(self.keys) - 1) if len(slot) == len(keys) else (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[hit]]
            on = ~hit & (found != np.iinfo(np.int64).min)
            more, slot = more[on], slot[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        if 3 * (self.n + len(keys)) > len(self.keys):
            there = self.keys != np.iinfo(np.int64).min
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            self.__init__(max(12, int(6 * len(keys)).bit_length()))
        self.n += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.iinfo(np.int64).min
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & (len(self.keys) - 1)


class Codec:
    """Whole-text encoding and decoding with one model."""

    def __init__(self, model: dict):
        self.model, self.search = model, StreamingViterbi(model)
        self.codes = np.zeros(0x110000, np.int32)  # of each character of a piece; 0 for the rest
        for i, ch in enumerate(sorted({ch for _, ch, _ in model["edges"]}), 1):
            self.codes[ord(ch)] = i
        self.width = int(self.codes.max()) + 1
        self.first = np.full(self.width, -1, np.int64)  # root's child for each code
        keys, to = [], []
        for frm, ch, node in model["edges"]:
            if frm:
                keys.append(frm * self.width + int(self.codes[ord(ch)]))
                to.append(node)
            else:
                self.first[self.codes[ord(ch)]] = node
        self.next = NumberMap()
        self.next.put(np.array(keys, np.int64), np.array(to, np.int32))
        self.leads = np.zeros(len(model["node_piece"]), bool)  # whether a node has children
        self.leads[[frm for frm, *_ in model["edges"]]] = True
        self.piece, self.score = np.array(model["node_piece"], np.int32), np.array(model["node_score"], np.int64)
        self.apart = NumberMap()
        inner = sorted({ch for p in model["pieces"] if len(p) > 1 for ch in p})
        self.inner = np.zeros(0x110000, np.int32)
        for i, ch in enumerate(inner, 1):
            self.inner[ord(ch)] = i
        self.beside = np.zeros((len(inner) + 1,) * 2, bool)
        for p in model["pieces"]:
            for a, b in zip(p, p[1:], strict=False):
                self.beside[self.inner[ord(a)], self.inner[ord(b)]] = True
        self.powers = np.ones(1, np.uint64)
        self._forget()
        # a one-byte character is whole on its own
        self.plain = [model["plain"].get(i, chr(int(n[3:5], 16)) if k == 6 and int(n[3:5], 16) < 128 else None)
                      for i, (n, k) in enumerate(zip(model["names"], model["kinds"], strict=True))]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None], share: bool = True) -> list[np.ndarray]:
        """The ids of each text; short texts share a block, a long one has several."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        block: list[tuple[int, str]] = []
        held = 0

        def settle() -> None:
            if block:
                ids, ends = self._shared("\n".join(t for _, t in block), [len(t) for _, t in block])
                for (i, _), a, b in zip(block, np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    out[i] = ids[a:b]
                block.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            marked = " " + t if self.model["prefix"] else t
            if MARK in marked and self.model["bytes"]:
                marked = marked.replace(MARK, LITERAL)
            marked = marked.replace(" ", MARK)
            if self.model["odd"] or not share:
                out[i] = np.array(self.search.encode(marked), np.int32)
            elif len(marked) > BLOCK:
                out[i] = self._long(marked)
            else:
                if held + len(marked) > BLOCK:
                    settle()
                    held = 0
                block.append((i, marked))
                held += len(marked) + 1
        settle()
        return out

    def _long(self, marked: str) -> np.ndarray:
        """A long text, block by block; a block without a cut, and what follows it, goes through the window whole."""
        parts, at = [], 0
        while at < len(marked):
            end = min(at + BLOCK, len(marked))
            if end < len(marked):
                cuts = self._cuts(np.frombuffer(marked[at : end + 1].encode("utf-32-le", "surrogatepass"), np.uint32))
                if not len(cuts):
                    parts.append(np.array(self.search.encode(marked[at:]), np.int32))
                    break
                end = at + int(cuts[-1])
            parts.append(self._shared(marked[at:end], [end - at])[0])
            at = end
        return np.concatenate(parts)

    def _cuts(self, cps: np.ndarray) -> np.ndarray:
        """Places between two characters that stand side by side in no piece."""
        code = self.inner[cps]
        return np.flatnonzero(~self.beside[code[:-1], code[1:]]) + 1

    def _shared(self, joined: str, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts joined by line breaks, and where each text's end among them."""
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.array(sizes) + 1) - 1  # the line break after each text, no character of it
        cut = np.zeros(len(cps) + 1, bool)
        cut[self._cuts(cps)] = True
        cut[0] = True
        cut[ends] = True
        cut[ends[:-1] + 1] = True
        at = np.flatnonzero(cut[:-1])
        size = np.diff(np.append(at, len(cps)))
        real = np.ones(len(cps) + 1, bool)
        real[ends] = False
        at, size = at[real[at]], size[real[at]]
        while len(self.powers) < size.max():
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(0xD6E8FEB86659FD93) ** np.uint64(len(self.powers))])
        place = np.arange(len(cps)) - np.repeat(at, np.diff(np.append(at, len(cps))))
        weighed = (cps + np.uint64(0x9E37)) * self.powers[np.minimum(place, len(self.powers) - 1)]
        weighed[ends[:-1]] = 0
        key = np.add.reduceat(weighed, at)
        key = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
        which = self.known.get(key)
        if (which < 0).any():
            if self.known.n > STRETCHES:
                self._forget()
                which = np.full(len(key), -1)
            fresh, first = np.unique(key[which < 0], return_index=True)
            first = np.flatnonzero(which < 0)[first]
            spans = size[first] + 1
            begin = np.cumsum(spans) - spans
            spread = np.arange(int(spans.sum())) + np.repeat(at[first] - begin, spans)
            ids, stops = self._block(np.append(cps, [10])[np.minimum(spread, len(cps))], size[first])
            self.known.put(fresh, np.arange(len(self.count), len(self.count) + len(fresh), dtype=np.int32))
            counts = np.diff(stops, prepend=0)
            self.offset = np.concatenate([self.offset, len(self.ids) + np.cumsum(counts) - counts])
            self.count, self.ids = np.concatenate([self.count, counts]), np.concatenate([self.ids, ids])
            which = self.known.get(key)
        n = self.count[which]
        upto = np.cumsum(n)
        spread = np.arange(int(upto[-1])) + np.repeat(self.offset[which] - (upto - n), n)
        stops = np.searchsorted(at, ends, "left")
        return self.ids[spread], upto[stops - 1]

    def _forget(self) -> None:
        #: Stretches that are known: hash to number, and of each number where its ids are.
        self.known = NumberMap()
        self.offset, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _block(self, cps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of stretches with one more character after each, and where each stretch's end among them."""
        longest = self.model["longest"]
        n = len(cps)
        gaps = np.cumsum(sizes + 1) - 1
        code = np.zeros(n + longest + 1, np.int32)
        code[:n] = self.codes[cps]
        code[gaps] = 0
        # pieces that start at each place, a character longer each time
        starts, node = np.arange(n), self.first[code[:n]]
        starts, node = starts[node >= 0], node[node >= 0]
        found = []
        reach = np.arange(1, n + 1)
        for size in range(1, longest + 1):
            whole = self.piece[node] >= 0
            found.append((starts[whole], np.full(int(whole.sum()), size, np.int32), self.piece[node[whole]], self.score[node[whole]]))
            reach[starts[whole]] = size + starts[whole]
            go = self.leads[node] & (code[starts + size] > 0)
            starts, node = starts[go], node[go]
            if not len(starts):
                break
            node = self.next.get(node * self.width + code[starts + size]).astype(np.int64)
            starts, node = starts[node >= 0], node[node >= 0]
        # boundaries that no piece passes over: all paths meet there
        sure = np.concatenate([[0], np.flatnonzero(np.maximum.accumulate(reach)[:-1] <= np.arange(1, n)) + 1, [n]])
        at, size, piece, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at, size, piece, score = at[order], size[order], piece[order], score[order]
        count = np.bincount(at, minlength=n + 1)
        offset = np.cumsum(count) - count
        what, back = np.full(n + longest + 1, NONE, np.int64), np.zeros(n + longest + 1, np.int64)
        best = None if self.model["merges"] else np.full(n + longest + 1, NEVER, np.int64)
        begin, length = sure[:-1], np.diff(sure)
        wide = np.flatnonzero(length > LANE)
        begin, length = begin[length <= LANE], length[length <= LANE]
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        for t in range(int(length[0]) if len(length) else 0):
            here = begin[: np.searchsorted(-length, -t, "left")] + t
            prior = what[here] if t else np.full(len(here), START, np.int64)
            if best is not None:
                own = best[here] if t else np.zeros(len(here), np.int64)
            rows, nth = np.flatnonzero(count[here] > 0), 0
            while len(rows):
                k = offset[here[rows]] + nth
                end = here[rows] + size[k]
                if best is None:
                    free = np.flatnonzero(what[end] == NONE)
                    r, k, end = rows[free], k[free], end[free]
                    ok = self._apart(prior[r], piece[k].astype(np.int64))
                else:
                    r, value = rows, own[rows] + score[k]
                    ok = value > best[end]
                    best[end[ok]] = value[ok]
                what[end[ok]], back[end[ok]] = piece[k[ok]], here[r[ok]]
                nth += 1
                rows = rows[count[here[rows]] > nth]
            if best is None:
                lost = here[what[here + 1] == NONE]
            else:
                low = own + self.search.unknown
                lost = here[low > best[here + 1]]
                best[here + 1] = np.maximum(best[here + 1], low)
            what[lost + 1], back[lost + 1] = UNKNOWN, lost
        # the paths from the end of each stretch back to its start
        last = np.zeros(n + 1, bool)
        spot, stop = begin + length, begin
        while len(spot):
            last[spot] = True
            spot = back[spot]
            on = spot > stop
            spot, stop = spot[on], stop[on]
        last[np.minimum(gaps + 1, n)] = False
        ends = np.flatnonzero(last)
        ids = what[ends]
        strange = np.flatnonzero(ids < 0)
        extra: list[tuple[int, list[int]]] = []  # where they end, and the ids
        after = -1
        for i in strange.tolist():
            e = int(ends[i])
            if self.model["bytes"]:
                raw = chr(cps[e - 1]).replace(LITERAL, MARK).encode("utf-8", "surrogatepass")
                extra.append((e, [self.model["bytes"][b] for b in raw]))
            else:  # the library joins unknown characters that touch
                extra.append((e, [] if after == e - 1 else [self.model["unknown"]]))
                after = e
        for w in wide.tolist():
            a, b = int(sure[w]), int(sure[w + 1])
            extra.append((b, self.search.encode(cps[a:b].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"))))
        if not extra:
            return ids.astype(np.int32), np.searchsorted(ends, gaps, "right")
        # each id with the place of its last character; stretches and bytes are put in where they belong
        keep = ids >= 0
        value = np.concatenate([ids[keep], *[np.array(x, np.int64) for _, x in extra]])
        place = np.concatenate([ends[keep], *[np.full(len(x), e) for e, x in extra]])
        order = np.argsort(place, kind="stable")
        return value[order].astype(np.int32), np.searchsorted(place[order], gaps, "right")

    def _apart(self, prior: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece stays apart from the one before it."""
        keys = prior << 24 | piece
        known = self.apart.get(keys)
        new = known < 0
        if new.any():
            if self.apart.n > PAIRS:
                self.apart = NumberMap()
                return self._apart(prior, piece)
            names, fresh = self.model["names"], np.unique(keys[new])
            values = [self.search.stay_apart(k, names[k >> 24] if k >> 24 >= 0 else "", names[k & 0xFFFFFF]) for k in fresh.tolist()]
            self.apart.put(fresh, np.array(values, np.int32))
            known[new] = self.apart.get(keys[new])
        return known > 0

    def decode(self, ids) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except TypeError:
            text = self._decode_each(ids)
        return text[1:] if self.model["prefix"] and text.startswith(" ") else text

    def _decode_each(self, ids) -> str:
        names, kinds = self.model["names"], self.model["kinds"]
        out, pending = [], bytearray()
        for i in ids:
            if kinds[i] == 6:
                pending.append(int(names[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "surrogatepass"))
                pending = bytearray()
            out.append(names[i].replace(MARK, " ") if kinds[i] in (1, 4) else " ⁇ " if kinds[i] == 2 else "")
        if pending:
            out.append(pending.decode("utf-8", "surrogatepass"))
        return "".join(out)


def encode_documents(docs: DataFrame, model_path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns kept, ids and n_tokens of each row; round_trip: whether the ids decode to the text exactly."""
    if clash := {"ids", "n_tokens", "round_trip"} & {c.lower() for c in keep}:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(model_path))

    def of(batches):
        model = shared.value  # one object for all tasks of a worker, and so is what the codec has learned of pairs
        codec = model.setdefault("codec", None) or Codec(model)
        model["codec"] = codec
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("text").to_pylist()
                ids = codec.encode_all(texts)
                same = [codec.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                for j in (j for j, ok in enumerate(same) if not ok):
                    ids[j] = codec.encode_all([texts[j]], share=False)[0]
                    same[j] = codec.decode(ids[j]) == (texts[j] or "")
                sizes = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), lists, pa.array(sizes), pa.array(same)], [*keep, "ids", "n_tokens", "round_trip"]
                )

    fields = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(of, f"{fields}, ids array<int>, n_tokens long, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, comma-joined) and round_trip of every document."""
    return encode_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip"
    )
