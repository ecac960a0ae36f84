"""The pieces of a SentencePiece BPE model, and which of them can stand side by side in an encoding.

The encoder merges the adjacent pair of best rank first, the leftmost of equals. Two facts make its result local. A
sequence of pieces is an encoding exactly if each piece encodes to itself and each adjacent pair is compatible. And two
pieces are incompatible exactly if a piece on the right edge of the left one's merge tree and one on the left edge of the
right one's tree join to a piece that ranks before the merges that consume them. `Pieces.spines` gives those edges
as (length, rank of the consuming merge), which is all that a lattice search needs.

Runs of the space mark only join each other, after everything else and from the left; they are counted apart (`marks`),
and no other piece has a mark anywhere but at its start. So a text falls into segments at its spaces. Where no piece holds a
letter beside another character, a segment falls further into chunks, which recur more often than whole words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import sentencepiece

MARK = "▁"
NEVER = 1 << 30
SPINES, FITS = 50_000, 300_000  # entries that a worker remembers of each kind; a split belongs to a piece, so their number is the model's
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
CHUNK = re.compile(rf" ?(?:[{LETTERS}]+|[^{LETTERS} ]+)")
SEAM = re.compile(rf"[{LETTERS}][^{LETTERS}]|[^{LETTERS}{MARK}][{LETTERS}]")


class Pieces:
    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids, self.rank, self.bytes = {}, {}, {}
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[sp.id_to_piece(i)] = i
        runs = {p for p in self.ids if len(p) > 1 and not p.strip(MARK)}
        scored = sorted((p for p in self.ids.keys() - runs if len(p) > 1), key=lambda p: -sp.get_score(self.ids[p]))
        if any(MARK in p[1:] for p in scored) or len({sp.get_score(self.ids[p]) for p in runs}) > 1:
            raise ValueError("the model's space marks do not follow the rules that this module relies on")
        self.runs = {len(p) for p in runs}
        self.rank = {p: k for k, p in enumerate(scored)}
        self.single = {p for p in self.ids if len(p) == 1}
        self.longest = max(map(len, scored))
        # The ends and the beginnings of pieces, and whether each is a piece itself.
        self.heads = {p[:k]: p[:k] in self.rank for p in scored for k in range(2, len(p) + 1)}
        self.tails = {p[k:]: p[k:] in self.rank for p in scored for k in range(len(p) - 1)}
        self.text = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self._split: dict[str, tuple[str, str] | None] = {}
        self.apart = not any(map(SEAM.search, scored))
        self.chunk_pattern = CHUNK.pattern if self.apart else " [^ ]+"
        self._spines: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        self._fits: dict[str, dict[str, bool]] = {}
        self._known = 0  # entries of all rows of _fits

    def split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece of two characters or more; None if the encoder never makes it."""
        if piece not in self._split:
            parts = list(piece)
            while len(parts) > 2:
                best = min(((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
                if best[0] == NEVER:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            self._split[piece] = tuple(parts) if len(parts) == 2 else None
        return self._split[piece]

    def spine(self, piece: str, right: bool) -> list[tuple[str, int]]:
        """The pieces on one edge of a piece's merge tree, outermost first, each with the rank of the merge that consumes it."""
        found = self._spines.get((piece, right))
        if found is None:
            if len(self._spines) > SPINES:
                self._spines.clear()
            inner = self.spine(self.split(piece)[right], right) if len(piece) > 1 else []
            found = self._spines[(piece, right)] = [(piece, NEVER), *((x, min(r, self.rank[piece])) if k == 0 else (x, r) for k, (x, r) in enumerate(inner))]
        return found

    def follows(self, a: str) -> dict[str, bool]:
        """What is known of the pieces that can follow a in an encoding; `fits` adds to it."""
        row = self._fits.get(a)
        if row is None:
            if self._known > FITS:
                self._fits.clear()
                self._known = 0
            self._known += 4  # a row of its own
            row = self._fits[a] = {}
        return row

    def fits(self, a: str, b: str) -> bool:
        """Whether b can follow a in an encoding; with an empty a, whether b can begin one."""
        row = self.follows(a)
        found = row.get(b)
        if found is None:
            found = len(b) == 1 or self.split(b) is not None
            if found and a:
                get, right = self.rank.get, self.spine(b, False)
                found = not any(get(x + y, NEVER) < min(before, until + 1) for x, before in self.spine(a, True) for y, until in right)
            row[b] = found
            self._known += 1
        return found

    def prefixes(self, word: str) -> tuple[list[int], list[bool], list[str]]:
        """For each prefix of a segment, shortest first: its token count, whether its first token is a lone mark, its last piece.

        The encoding of a prefix ends in the one piece that is compatible with the encoding of what is before it.
        """
        counts, lone, last, rows = [0], [False], [""], [self.follows("")]
        tails, single = self.tails, self.single
        for i in range(1, len(word) + 1):
            for j in range(i - 2, -1, -1):
                piece = word[j:i]
                whole = tails.get(piece)
                if whole is None:  # no longer piece ends here
                    piece = ""
                    break
                if whole:
                    found = rows[j].get(piece)
                    if found is None:
                        found = self.fits(last[j], piece)
                    if found:
                        counts.append(counts[j] + 1)
                        lone.append(lone[j])
                        break
            else:
                piece = ""
            if not piece:
                piece = word[i - 1]
                counts.append(counts[i - 1] + (1 if piece in single else len(piece.encode())))
                lone.append(lone[i - 1] if i > 1 else piece == MARK)
            last.append(piece)
            rows.append(self.follows(piece))
        return counts[1:], lone[1:], last[1:]

    def chunks(self, text: str) -> list[str]:
        """A text without runs of spaces or marks, in independent chunks; a leading space is a space mark. The first is the dummy's."""
        return CHUNK.findall(" " + text) if self.apart else list(map(" ".__add__, text.split(" ")))

    def longest_at(self, word: str, at: int) -> str:
        """The longest piece that starts here; the character itself if there is none."""
        heads, best = self.heads, at + 1
        for end in range(at + 2, len(word) + 1):
            whole = heads.get(word[at:end])
            if whole is None:
                break
            if whole:
                best = end
        return word[at:best]

    def shorter(self, piece: str) -> str:
        """The longest piece that begins this one and is shorter; empty for a character."""
        for end in range(len(piece) - 1, 1, -1):
            if piece[:end] in self.rank:
                return piece[:end]
        return piece[:1] if len(piece) > 1 else ""

    def path(self, word: str) -> list[str]:
        """The pieces of a segment's encoding: the one path whose neighbours fit, longest pieces tried first, places that end nowhere once."""
        out, row, at, dead, n = [], self.follows(""), 0, set(), len(word)
        rows, piece = [], self.longest_at(word, 0) if word else ""
        while at < n:
            end = at + len(piece)
            found = False
            if end not in dead:
                found = row.get(piece)
                if found is None:
                    found = self.fits(out[-1] if out else "", piece)
            if found:
                out.append(piece)
                rows.append(row)
                row, at = self.follows(piece), end
                piece = self.longest_at(word, at) if at < n else ""
                continue
            piece = self.shorter(piece)
            while not piece:
                dead.add(at)
                last = out.pop()
                row, at = rows.pop(), at - len(last)
                piece = self.shorter(last)
        return out

    def encode(self, word: str) -> list[int]:
        """The ids of a segment."""
        ids, own = self.ids.get, []
        for p in self.path(word):
            k = ids(p)
            if k is None:
                own += [self.bytes[b] for b in p.encode()]
            else:
                own.append(k)
        return own

    def marks(self, n: int) -> list[int]:
        """The lengths of the pieces that a run of n space marks becomes, if nothing else joins it."""
        out: list[int] = []
        for _ in range(n):
            if out and out[-1] + 1 in self.runs:
                out[-1] += 1
                if len(out) > 1 and out[-2] + out[-1] in self.runs:
                    out[-2:] = [out[-2] + out[-1]]
            else:
                out.append(1)
        return out

    def mark_ids(self, n: int) -> list[int]:
        return [self.ids[MARK * k] for k in self.marks(n)]


class Memo(dict):
    """Values of recent chunks. Two generations: what is in use outlives a full table."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.make(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


@lru_cache(maxsize=4)
def load(model: str) -> Pieces:
    return Pieces(model)


def segments(text: str) -> list[tuple[int, str]]:
    """(marks, word) of the normalised text: runs of spaces and what follows each. An empty text has none."""
    if not text:
        return []
    out, run = [], 0
    for part in text.split(" "):
        run += 1
        if part:
            for k, own in enumerate(part.split(MARK)) if MARK in part else [(0, part)]:
                run += k > 0
                if own:
                    out.append((run, own))
                    run = 0
    if run:
        out.append((run, ""))
    return out
