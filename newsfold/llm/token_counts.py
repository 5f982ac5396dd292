"""Token counts of a sentence-piece vocabulary, most of them by looking a pre-token up.

No piece of the vocabulary has a word mark after another character (``whole_tokens`` checks it), so no merge crosses the
start of a run of word marks: a text is the chain of its pre-tokens, each a run of marks with the characters up to the
next run, and each encodes by itself. The pieces that encode alone as one token are found once; a pre-token among them
counts one. The others are merged by the library, many in one call, and remembered in a bounded table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from newsfold.llm.text import documents

MARK = "▁"
_RUNS = re.compile(" +[^ ]*")
#: Pre-tokens that a worker remembers beside the whole tokens.
REMEMBER = 400_000
LIMIT = 4096


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def whole_tokens(model: str) -> frozenset[str]:
    """The strings after one word mark that encode as one token; raises if pieces could span pre-tokens."""
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece has a word mark inside: pre-tokens don't encode by themselves")
    if sp.encode("  a", out_type=str) == sp.encode("a", out_type=str):
        raise ValueError("the model drops spaces: runs of them can't be told apart")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1)


class Counter:
    """Counts of texts; keeps what it has learnt about pre-tokens."""

    def __init__(self, model: str, whole: frozenset[str]):
        self.sp, self.whole = processor(model), whole
        self.known = dict.fromkeys(whole, 1)
        self.starts = [self.sp.id_to_piece(i).startswith(MARK) for i in range(self.sp.get_piece_size())]

    def _learn(self, words: list[str]) -> None:
        """Counts of pre-tokens with one mark: encoded together, cut where a piece starts with the mark."""
        if len(self.known) > REMEMBER:
            self.known = dict.fromkeys(self.whole, 1)
        starts, known = self.starts, self.known
        ids = self.sp.encode(" ".join(words))
        at = [i for i, x in enumerate(ids) if starts[x]]
        at.append(len(ids))
        for k, w in enumerate(words):
            known[w] = at[k + 1] - at[k]

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = []
        for t in texts:
            t = (t or "").replace(MARK, " ")
            if not t:
                cut.append(([], 0))
            elif "  " in t or t[0] == " " or t[-1] == " ":
                runs = _RUNS.findall(" " + t)
                cut.append(([r[1:] for r in runs if len(r) > 1 and r[1] != " "], sum(len(self.sp.encode(r[1:])) or 1 for r in runs if len(r) == 1 or r[1] == " ")))
            else:
                cut.append((t.split(" "), 0))
        new = list({w for words, _ in cut for w in words if w not in self.known})
        for i in range(0, len(new), 2000):
            self._learn(new[i : i + 2000])
        out = []
        for words, more in cut:
            try:
                out.append(more + sum(map(self.known.__getitem__, words)))
            except KeyError:  # the table was emptied in between
                self._learn(list({w for w in words if w not in self.known}))
                out.append(more + sum(self.known.get(w) or len(self.sp.encode(w)) for w in words))
        return out


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; null text is empty and has no tokens.

    Begin and end marks don't count, and special strings in a text are plain text, as in the library. One pass without a
    shuffle; repeated rows are repeated in the result. model: a path that every executor can read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(model))  # bounded by the vocabulary

    def run(batches):
        counter = Counter(model, whole.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
