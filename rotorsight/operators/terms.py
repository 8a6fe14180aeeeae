"""Which of very many terms occur in each text: Aho-Corasick automata inside Spark tasks.

The distinct terms become automata of bounded size: a trie in breadth-first order, kept as arrays
(transitions as one sorted key array, failure links, output links). Each automaton travels to the
tasks once and every text is read once per automaton, whatever the number of terms; what comes out
are the matches, not candidates. Inside a task the texts of a batch are cut into lanes that
overlap by the longest term, and all lanes advance together, so neither one long text nor many
short ones make a slow row loop.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Characters of terms per automaton: below 25 bytes each, so at most 100 MB of arrays.
BLOCK_CHARS = 4 << 20
#: Characters of a lane without its overlap, and of texts that are searched together.
LANE = 512
TEXT_CHARS = 4 << 20


class Automaton(NamedTuple):
    """States are numbered in breadth-first order, so the transitions of all are sorted by key."""

    terms: list            # distinct and sorted
    alphabet: np.ndarray   # code points that occur in terms; a letter is a place in it, plus one
    keys: np.ndarray       # state * (letters + 1) + letter, rising; the n-th key leads to state n + 1
    fail: np.ndarray       # the longest proper suffix that is a state
    term: np.ndarray       # the term that ends at the state, or -1
    more: np.ndarray       # the next shorter state on the failure path that ends a term, or 0
    longest: int

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states for some lanes; letter 0 is in no term."""
        out, todo = np.zeros_like(state), np.nonzero(letter)[0]
        while len(todo):
            want = state[todo] * (len(self.alphabet) + 1) + letter[todo]
            at = np.searchsorted(self.keys, want)
            found = at < len(self.keys)
            found[found] = self.keys[at[found]] == want[found]
            out[todo[found]] = at[found] + 1
            todo = todo[~found]
            todo = todo[state[todo] > 0]       # at the root an unknown letter stays there
            if len(todo):
                state = state.copy()
                state[todo] = self.fail[state[todo]]
        return out

    def letters(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, codes)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == codes, at + 1, 0)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and where each text ends."""
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), np.cumsum([0, *map(len, texts)])


def automaton(terms: list[str]) -> Automaton:
    """The automaton of some non-empty terms, built level by level."""
    terms = sorted(set(terms))
    codes, at = _codes(terms)
    alphabet = np.unique(codes)
    base = len(alphabet) + 1
    letters = np.searchsorted(alphabet, codes) + 1
    size = np.diff(at)
    state = np.zeros(len(terms), np.int64)     # where each term stands in the trie
    keys, fail, parents, firsts = [], [np.zeros(1, np.int64)], [], 1
    term = np.full(len(codes) + 1, -1, np.int64)
    for depth in range(size.max(initial=0)):
        alive = np.nonzero(size > depth)[0]
        key, place = np.unique(state[alive] * base + letters[at[alive] + depth], return_inverse=True)
        keys.append(key)
        state[alive] = firsts + place
        done = alive[size[alive] == depth + 1]
        term[state[done]] = done
        parents.append(key)
        firsts += len(key)
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    tree = Automaton(terms, alphabet, keys, np.zeros(firsts, np.int64), term[:firsts],
                     np.zeros(firsts, np.int64), int(size.max(initial=0)))
    low = 1
    for key in parents:                        # links of a level need those of shorter states only
        high = low + len(key)
        if low > 1:
            tree.fail[low:high] = tree.step(tree.fail[key // base], key % base)
        links = tree.fail[low:high]
        tree.more[low:high] = np.where(tree.term[links] >= 0, links, tree.more[links])
        low = high
    return tree


def occurrences(tree: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (number of the text, number of the term that occurs in it)."""
    codes, at = _codes(texts)
    letters = tree.letters(codes) if len(codes) and len(tree.alphabet) else np.zeros(len(codes), int)
    sizes = np.diff(at)
    lanes = -(-sizes // LANE)
    owner = np.repeat(np.arange(len(texts)), lanes)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = at[:-1][owner] + first * LANE
    stop = np.minimum(start + LANE + max(tree.longest - 1, 0), at[1:][owner])
    state, found = np.zeros(len(owner), np.int64), []
    ends = (tree.term >= 0) | (tree.more > 0)
    lane = np.arange(len(owner))
    for place in range(int((stop - start).max(initial=0))):
        lane = lane[start[lane] + place < stop[lane]]
        state[lane] = tree.step(state[lane], letters[start[lane] + place])
        hit = lane[ends[state[lane]]]
        at_state = state[hit]
        while len(hit):
            is_term = tree.term[at_state] >= 0
            found.append(owner[hit[is_term]] * len(tree.terms) + tree.term[at_state[is_term]])
            at_state = tree.more[at_state]
            hit, at_state = hit[at_state > 0], at_state[at_state > 0]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // max(len(tree.terms), 1), pairs % max(len(tree.terms), 1)


def _blocks(terms: DataFrame, block_chars: int):
    """Distinct terms in blocks of bounded length (one longer term is a block of its own)."""
    block, size = [], 0
    for (term,) in terms.toLocalIterator():
        if block and size + len(term) > block_chars:
            yield block
            block, size = [], 0
        block.append(term)
        size += len(term)
    if block:
        yield block


def _text_blocks(sizes: list[int]):
    """Row ranges of a batch whose texts together have a bounded length, or one text."""
    low, size = 0, 0
    for i, n in enumerate(sizes):
        if i > low and size + n > TEXT_CHARS:
            yield low, i
            low, size = i, 0
        size += n
    if len(sizes) > low:
        yield low, len(sizes)


def found_terms(rows: DataFrame, key: str, text: Column, terms: DataFrame,
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (key, term): each distinct term of ``terms`` (one string column) inside the text.

    Terms and texts are compared by code points. Null and empty terms and texts match nothing;
    rows that share a key give its matches once each. Every block of terms is one more scan of
    the texts; a block is the only thing that is broadcast, and its size is bounded.
    """
    spark = rows.sparkSession
    name = terms.columns[0]
    wanted = terms.select(name).filter(F.length(name) > 0).distinct()
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, term string"
    noted = rows.select(key, text.alias("note")).filter(F.length("note") > 0)

    def scan_for(block):
        shared = spark.sparkContext.broadcast(automaton(block))

        def scan(batches):
            tree = Automaton(*shared.value)
            for batch in batches:
                for low, high in _text_blocks(pc.utf8_length(batch.column(1)).to_pylist()):
                    part = batch.slice(low, high - low)
                    text_no, term_no = occurrences(tree, part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(text_no)),
                         pa.array([tree.terms[i] for i in term_no], pa.string())], [key, "term"])
        return noted.mapInArrow(scan, schema)

    found = None
    for block in _blocks(wanted, block_chars):
        more = scan_for(block)
        found = more if found is None else found.union(more)
    return spark.createDataFrame([], schema) if found is None else found
