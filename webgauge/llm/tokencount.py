"""Operator 2: word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links (Song et al., EMNLP 2021).  Each node
knows how many pieces are popped when its failure link is followed, so the number
of greedy longest-match pieces of a word comes out of one left-to-right walk that
never goes back and never builds a piece.

A word is a run of ``[^\\x20\\x09-\\x0D]``.  It is read behind the vocabulary's
word-start mark; a word that the pieces cannot cover counts as one unknown token,
as usual for word pieces.  Counts of words seen lately are kept in a bounded
per-task memo; that is a cache only, every word is counted.

Plan: one scan, no shuffle; the vocabulary (tens of thousands of pieces, a fixed
file) is the only thing sent to the executors.

Edge cases: null and empty texts have no words and no tokens; ties and repeated
rows are counted row by row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
_MEMO_CHARS = 8_000_000


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The normal pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: give count_tokens the pieces of another one (load_pieces(path))")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class LongestMatch:
    """Counts the greedy longest-match pieces of ``start + word``."""

    def __init__(self, pieces: Iterable[str], start: str = START):
        children: list[dict[str, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            node = 0
            for char in piece:
                after = children[node].get(char)
                if after is None:
                    after = len(children)
                    children[node][char] = after
                    children.append({})
                    is_piece.append(False)
                node = after
            is_piece[node] = node != 0
        # breadth first: a failure link points to a shallower node
        fail = [-1] * len(children)
        popped = [0] * len(children)
        queue = [0]
        for node in queue:
            for char, after in children[node].items():
                queue.append(after)
                if is_piece[after]:
                    fail[after], popped[after] = 0, 1
                    continue
                z, n = fail[node], popped[node]
                while z >= 0 and char not in children[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[after], popped[after] = children[z][char], n
        # pieces popped when the word ends in a node; -1: it can't be covered
        last = [0] * len(children)
        for node in queue[1:]:
            rest = last[fail[node]] if fail[node] >= 0 else -1
            last[node] = popped[node] + rest if rest >= 0 else -1
        self.children, self.fail, self.popped, self.last = children, fail, popped, last
        self.root, self.before = 0, 0
        for char in start:
            self.root, n = self._step(self.root, char)
            self.before += n

    def _step(self, node: int, char: str) -> tuple[int, int]:
        n = 0
        while node >= 0:
            after = self.children[node].get(char)
            if after is not None:
                return after, n
            n += self.popped[node]
            node = self.fail[node]
        return -1, 0

    def count(self, word: str) -> int:
        """Number of pieces; 0 if the pieces cannot cover the word."""
        children, fail, popped = self.children, self.fail, self.popped
        node, n = self.root, self.before
        for char in word:
            after = children[node].get(char) if node >= 0 else None
            while after is None:
                if node < 0:
                    return 0
                n += popped[node]
                node = fail[node]
                if node >= 0:
                    after = children[node].get(char)
            node = after
        if node < 0:
            return 0
        rest = self.last[node]
        return n + rest if rest >= 0 else 0


def counter(matcher: LongestMatch):
    """text -> (words, tokens, unknown words), with a memo of bounded size."""
    memo: dict[str, int] = {}
    held = 0

    def measure(text: str | None) -> tuple[int, int, int]:
        nonlocal held
        n_words = n_tokens = n_unknown = 0
        if not text:
            return 0, 0, 0
        for word, times in Counter(_WORD.findall(text)).items():
            pieces = memo.get(word)
            if pieces is None:
                pieces = matcher.count(word)
                if held > _MEMO_CHARS:
                    memo.clear()
                    held = 0
                memo[word] = pieces
                held += len(word) + 16
            n_words += times
            if pieces:
                n_tokens += times * pieces
            else:
                n_tokens += times
                n_unknown += times
        return n_words, n_tokens, n_unknown

    return measure


def count_tokens(docs: DataFrame, pieces: list[str], start: str = START, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = counter(LongestMatch(*shared.value))
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column(1)]
            sums = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), load_pieces())


def op2_sql(pieces: list[str], start: str = START) -> str:
    """Greedy longest matching, a piece a round, of all distinct words at once."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""
with recursive v as (
  select unnest([{", ".join(map(quoted, pieces))}]) as piece
), d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), u as (
  select distinct unnest(w) as word from d
), g as (
  select word, {quoted(start)} || word as rest, 0 as n from u
  union all
  select word, substr(rest, max(l) + 1) as rest, n + 1 as n
  from (select word, rest, n, unnest(range(1, {max(map(len, pieces)) + 1})) as l from g where rest <> '') c join v on v.piece = substr(rest, 1, l) and length(rest) >= l
  group by word, rest, n
), c as (
  select word, max(n) filter (rest = '') as pieces from g group by word
), e as (
  select doc_id, unnest(w) as word from d
)
select d.doc_id, count(e.word)::bigint as n_words, coalesce(sum(case when e.word is not null then coalesce(c.pieces, 1) end), 0)::bigint as n_tokens,
  count(e.word) filter (c.pieces is null)::bigint as n_unknown
from d left join e on e.doc_id = d.doc_id left join c on c.word = e.word group by d.doc_id
"""
