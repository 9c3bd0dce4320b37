"""Token counts by a finite-state transducer compiled from a subword vocabulary.

Byte-pair encoding of a prefix of a text is a prefix function: its last token is the one
token ``t`` that ends there and forms a valid pair with the last token of what stands
before ``t``, a pair being valid if encoding it gives just the two. What the future can
ask about a prefix is therefore finite: for each suffix that some token starts with, the
last token before it and how many tokens there were, relative to now. ``Transducer`` takes
that as its states, with the last token reduced to the set of tokens it lets follow where
few can (``FEW``), so that contexts with the same future are one state. A transition reads one byte and is annotated with the tokens it emits
(a signed number: a byte that completes a longer token takes back shorter ones). States and
transitions are compiled when a text first needs them, and kept in arrays; a table of more
than ``STATES`` states is dropped and compiled anew, which changes no result.

A task lays the texts of a batch end to end, cuts them into chunks of about ``STEP`` bytes
and walks all chunks in lockstep. Each chunk gives a state map: the state it leaves and the
tokens it emits for the states it can be entered in. A chunk that starts with white space
after a letter, which no token spans, has a constant map; others are tabulated for the
state their left neighbour leaves, again until no entry is missing. The maps then compose
by a parallel prefix scan, in log2(chunks) rounds of numpy operations, to the totals of
the texts.

Spark has one narrow stage: texts in, numbers out, no shuffle. A text is never cut; memory
is a few bytes a byte of the longest text.

Defined cases: a null or empty text has no tokens. White space is ordinary text: a text
gets one more in front, as the library does. Characters outside the vocabulary count their
UTF-8 bytes. Strings that look like special tokens are ordinary text. Rows with equal ids
or texts are rows of their own; a null id stays null. An empty table gives an empty result.
Columns named in ``carry`` are kept, all others are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import carried, rest_ddl, uncarried

STEP = 256
STATES = 1 << 17
FEW = 32
MARK = "▁"
#: A last token that no merge crosses: nothing, or a character outside the vocabulary.
WALL = -1


class Vocabulary:
    """Pieces with their scores, as a trie over characters; characters that only occur inside pieces are tokens of their own."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.cost = {p: 1 for p in scores}
        for c in {c for p in scores for c in p}:
            self.cost.setdefault(c, len(c.encode()))
        self.tokens = sorted(self.cost)
        self.number = number = {p: i for i, p in enumerate(self.tokens)}
        #: per node: the children by character, and the token that ends there
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [WALL]
        for p in self.tokens:
            node = 0
            for c in p:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(WALL)
                node = self.children[node][c]
            self.token[node] = number[p]
        #: whether white space only starts tokens, after more white space at most
        self.spaces_lead = not any(MARK in p.lstrip(MARK) for p in scores)
        self.split = [self.last_merge(p) for p in self.tokens]
        #: how many tokens lie below each node; children have larger numbers than their parents
        self.weight = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            self.weight[node] = sum(self.weight[k] + (self.token[k] != WALL) for k in self.children[node].values())
        self._below: dict[int, tuple[int, ...]] = {}

    def below(self, node: int) -> tuple[int, ...]:
        """The tokens that continue a node's string."""
        got = self._below.get(node)
        if got is None:
            kids = self.children[node].values()
            got = self._below[node] = tuple(sorted([self.token[k] for k in kids if self.token[k] != WALL] + [x for k in kids for x in self.below(k)]))
        return got

    def encode(self, x: str) -> list[str]:
        """The pieces of x: the best-scored adjacent pair merges first, the leftmost of equals."""
        parts = list(x)
        while (at := self.best(parts)) is not None:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def best(self, parts: list[str]) -> int | None:
        found = [(-s, i) for i in range(len(parts) - 1) if (s := self.scores.get(parts[i] + parts[i + 1])) is not None]
        return min(found)[1] if found else None

    def last_merge(self, p: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives p, () for a character; None where p isn't made so that merges only get worse in score."""
        if len(p) == 1:
            return ()
        parts, before = list(p), None
        while len(parts) > 1:
            at = self.best(parts)
            if at is None:
                return None
            now = parts[at] + parts[at + 1]
            if before is not None and self.scores[now] > before:
                return None
            before = self.scores[now]
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [now]
        return last

    def follows(self, before: int, token: int) -> bool:
        """Does encoding the pair give just the two, so that token can follow before?

        Both are taken apart from the last merge back; at each moment their symbols at the boundary must not make a piece
        that would have merged before either one grew further. Where merges are not in order of score, the pair is encoded.
        """
        y = self.tokens[token]
        split, number, scores = self.split, self.number, self.scores
        if before == WALL:
            return split[token] is not None or self.encode(y) == [y]
        x = self.tokens[before]
        x_ends = y_ends = float("-inf")
        while True:
            a, b = split[number[x]], split[number[y]]
            if a is None or b is None:
                return self.encode(self.tokens[before] + self.tokens[token]) == [self.tokens[before], self.tokens[token]]
            joint = scores.get(x + y)
            if joint is not None and joint > x_ends and joint >= y_ends:
                return False
            if a and (not b or scores[x] < scores[y]):
                x_ends, x = scores[x], a[1]
            elif b:
                y_ends, y = scores[y], b[0]
            else:
                return True


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece model of the kind BPE with byte fallback and without rewriting of its input."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)})


class Transducer:
    """States and transitions over bytes, compiled on demand.

    ``to`` and ``emits`` have a row of 256 for each state, -1 in ``to`` where nothing is compiled yet.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = STATES):
        self.vocabulary, self.limit = vocabulary, limit
        self.clear()

    def clear(self) -> None:
        self.keys: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self._reduced: dict[tuple[int, int], tuple[int, ...]] = {}
        self.to = np.full((4096, 256), -1, np.int32)
        self.emits = np.zeros((4096, 256), np.int8)
        #: the state after nothing, and at the start of a text, where white space has been read
        self.empty = self.state((((0, WALL, 0),), b""))
        self.start, self.lead = self.after(self.keys[self.empty][0], MARK)
        self.start = self.state((self.start, b""))

    def state(self, key: tuple) -> int:
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.keys)
            self.keys.append(key)
            if got == len(self.to):
                self.to = np.concatenate((self.to, np.full_like(self.to, -1)))
                self.emits = np.concatenate((self.emits, np.zeros_like(self.emits)))
        return got

    def after(self, open_: tuple, c: str) -> tuple[tuple, int]:
        """The context after a character and the tokens it emits.

        A context has an entry for each suffix that can still grow into a token: (its trie node, the last token before it or
        the tokens that may follow there, tokens before it less those now).
        """
        v = self.vocabulary
        further = [(v.children[node][c], who, n) for node, who, n in open_ if c in v.children[node]]
        for node, who, n in further:
            token = v.token[node]
            if token != WALL and (token in who if isinstance(who, tuple) else v.follows(who, token)):
                emitted = n + v.cost[v.tokens[token]]
                rest = ((node, self.reduced(node, who), n - emitted) for node, who, n in further)
                return ((0, token, 0), *(e for e in rest if e[1] != ())), emitted
        return ((0, WALL, 0),), len(c.encode())

    def reduced(self, node: int, who):
        """The tokens below node that may follow, if these are few; else the token before."""
        v = self.vocabulary
        if isinstance(who, tuple):
            return tuple(x for x in who if x in v.below(node))
        if v.weight[node] > FEW:
            return who
        got = self._reduced.get((node, who))
        if got is None:
            got = self._reduced[node, who] = tuple(x for x in v.below(node) if v.follows(who, x))
        return got

    def compile(self, state: int, byte: int) -> None:
        open_, partial = self.keys[state]
        seen = partial + bytes([byte])
        if byte == 0x20 and not partial:
            open_, n = self.after(open_, MARK)
            seen = b""
        elif len(seen) < width(seen[0]):
            n = 0
        else:
            open_, n = self.after(open_, seen.decode("utf-8", "replace"))
            seen = b""
        to = self.state((open_, seen))
        self.to[state, byte], self.emits[state, byte] = to, n

    def walk(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state left, tokens emitted) of each chunk buf[at : at + size], entered in the given states."""
        order = np.argsort(-size, kind="stable")
        at, size, now = at[order], size[order], entry[order].astype(np.int64)
        total = np.zeros(len(at), np.int64)
        live = len(at)
        for k in range(int(size.max(initial=0))):
            while live and size[live - 1] <= k:
                live -= 1
            byte = buf[at[:live] + k].astype(np.int64)
            step = now[:live] * 256 + byte
            to = self.to.ravel()[step]
            if (to < 0).any():
                for missing in np.unique(step[to < 0]).tolist():
                    self.compile(*divmod(missing, 256))
                to = self.to.ravel()[step]
            total[:live] += self.emits.ravel()[step]
            now[:live] = to
        left, emitted = np.empty_like(now), np.empty_like(total)
        left[order], emitted[order] = now, total
        return left, emitted


def width(lead: int) -> int:
    """Bytes of the character with this first byte."""
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def cuts(buf: np.ndarray, offs: np.ndarray, spaces_lead: bool, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the chunks, whether each one's map is constant): every text starts one; cuts fall before a character, best before white space."""
    starts_of, ends_of = offs[:-1], offs[1:]
    inner = np.maximum(-(-(ends_of - starts_of) // step) - 1, 0)
    owner = np.repeat(np.arange(len(inner)), inner)
    wanted = starts_of[owner] + (np.arange(len(owner)) - (np.cumsum(inner) - inner)[owner] + 1) * step
    for _ in range(3):
        wanted = wanted + ((buf[np.minimum(wanted, len(buf) - 1)] & 0xC0) == 0x80) * (wanted < ends_of[owner])
    constant = np.zeros(len(wanted), bool)
    if spaces_lead:
        ascii_ = (buf[:-1] < 0x80) & (buf[:-1] != 0x20)
        good = np.flatnonzero((buf[1:] == 0x20) & ascii_) + 1
        if len(good):
            near = good[np.minimum(np.searchsorted(good, wanted), len(good) - 1)]
            constant = (near >= wanted) & (near - wanted < step // 2) & (near < ends_of[owner])
            wanted = np.where(constant, near, wanted)
    keep = wanted < ends_of[owner]
    at = np.concatenate((starts_of[starts_of < ends_of], wanted[keep]))
    constant = np.concatenate((np.zeros((starts_of < ends_of).sum(), bool), constant[keep]))
    order = np.argsort(at, kind="stable")
    return at[order], constant[order]


def scan(left: np.ndarray, emitted: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix composition of maps (entry -> left, emitted), tabulated at the entry each has after its left neighbour.

    With every map known where it is entered, composing two keeps the right one's exit and adds the emissions. Chunks of
    one group (a text) are neighbours; log2(chunks) doubling rounds.
    """
    left, emitted, n, reach = left.copy(), emitted.copy(), len(left), 1
    place = np.arange(n) - np.searchsorted(group, group)
    while reach < n and (place >= reach).any():
        to = np.flatnonzero(place >= reach)
        emitted[to] = emitted[to] + emitted[to - reach]
        reach *= 2
    return left, emitted


def count_tokens(machine: Transducer, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The number of tokens of each text of a chunk of texts."""
    total = np.zeros(len(offs) - 1, np.int64)
    if not len(buf):
        return total
    if len(machine.keys) > machine.limit:
        machine.clear()
    at, constant = cuts(buf, offs, machine.vocabulary.spaces_lead)
    group = np.searchsorted(offs, at, "right") - 1
    first = np.concatenate(([True], group[1:] != group[:-1]))
    size = np.diff(np.append(at, offs[-1]))
    entry = np.where(first, machine.start, machine.empty)
    left, emitted = machine.walk(buf, at, size, entry)
    settled = first | constant
    while True:
        wrong = np.flatnonzero(~settled & (entry != np.concatenate(([machine.empty], left[:-1]))))
        if not len(wrong):
            break
        entry[wrong] = left[wrong - 1]
        left[wrong], emitted[wrong] = machine.walk(buf, at[wrong], size[wrong], entry[wrong])
    emitted[first] += machine.lead
    _, sums = scan(left, emitted, group)
    last = np.append(first[1:], True)
    total[group[last]] = sums[last]
    return total


COUNTED = "n_bytes long, n_tokens long"
_machines: dict[tuple[str, int], Transducer] = {}


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit: more than ``limit`` tokens) for each row, and the columns in ``carry``.

    ``vocabulary`` is the path of a sentencepiece model that every executor can read.
    """
    rows = carried(docs, carry, id=F.col(doc_id), body=F.col(text))

    def counted(batches):
        machine = _machines.get((vocabulary, STATES))
        if machine is None:  # a worker that Spark uses again keeps what it has compiled
            machine = _machines[vocabulary, STATES] = Transducer(read_vocabulary(vocabulary))
        for batch in batches:
            bytes_, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, buf, offs in t.chunks(t.column(batch, "body")):
                bytes_.append(np.diff(offs))
                tokens.append(count_tokens(machine, buf, offs))
            yield pa.RecordBatch.from_arrays([t.column(batch, "id"), *(pa.array(np.concatenate(x), pa.int64()) for x in (bytes_, tokens)), t.column(batch, "rest")], names=["id", "n_bytes", "n_tokens", "rest"])

    got = rows.mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, {COUNTED}, {rest_ddl(rows)}")
    return uncarried(got, carry, F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
