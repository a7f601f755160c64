"""Token counts under a unigram vocabulary: count-only Viterbi over the matches that an Aho-Corasick automaton enumerates.

Every word (what stands between white space) is led by the word mark and cut into the pieces of the best score. As in the
tokenizers library, of equal scores the piece that starts first wins, and a character without a piece of its own costs the
least score less 10; with byte fallback it counts as its bytes, else a run of such characters counts as one piece.

A text's white space is what stands between words; it has no tokens of its own, as in a Metaspace tokenizer that splits a text
whose runs of white space are single blanks. Control pieces of the vocabulary (<s>, <0x41>) are matched where a text spells them,
as the library's model does with a word. Null and empty texts have no tokens; very long texts are counted whole, long words
without being remembered; repeated rows are counted alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from formlake.llm.kernels import chunks

#: The mark that leads a word, and what an unknown character costs below the least score.
WORD_MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a worker remembers, and bytes of the longest.
MEMORY_WORDS, WORD_BYTES = 300_000, 64


def zipf_lexicon(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file, scored as Zipf's law has it by their place in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 2.7)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of words."""

    def __init__(self, lexicon: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in lexicon:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in lexicon), default=0.0) - UNKNOWN_PENALTY
        known = {p for p, _ in lexicon}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.memory: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """The number of pieces of the best path. The matches of an end come longest first; a later one must be better to win."""
        n = len(word)
        best, pieces, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0

        def gap(end: int, reached: bool, single: bool) -> None:
            if single:
                return
            score = self.unknown + best[end - 1]
            if not reached or score > best[end]:
                best[end], lost[end] = score, True
                pieces[end] = pieces[end - 1] + (len(word[end - 1].encode()) if self.byte_fallback else not lost[end - 1])

        reached = single = False
        for at, (size, score) in self.automaton.iter(word) if len(self.automaton) else ():
            end = at + 1
            while done < end:  # the ends before this one get no more matches
                if done:
                    gap(done, reached, single)
                done += 1
                reached = single = False
            score += best[end - size]
            if not reached or score > best[end]:
                best[end], pieces[end], lost[end], reached = score, pieces[end - size] + 1, False, True
            single |= size == 1
        while done <= n:
            if done:
                gap(done, reached, single)
            done += 1
            reached = single = False
        return pieces[n]

    def totals(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, pieces) of each text."""
        if len(self.memory) > MEMORY_WORDS:
            self.before, self.memory = self.memory, {}
        memory, before, long = self.memory, self.before, {}
        found = [t.split() for t in texts]
        for w in dict.fromkeys(w for ws in found for w in ws):
            if w not in memory:
                n = before[w] if w in before else self.count(WORD_MARK + w.decode())
                if len(w) <= WORD_BYTES:
                    memory[w] = n
                else:
                    long[w] = n
        known = memory if not long else {w: memory.get(w, 0) or long[w] for ws in found for w in ws}
        return [(len(ws), sum(map(known.__getitem__, ws))) for ws in found]


def default_lexicon() -> list[tuple[str, float]]:
    import public_tokenizers

    return zipf_lexicon(public_tokenizers.path("piece_bpe_32k.model"))


def count_tokens(docs: DataFrame, lexicon: list[tuple[str, float]] | None = None, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text. The vocabulary, of a size that does not follow the corpus, is sent to the workers once."""
    sent = docs.sparkSession.sparkContext.broadcast(default_lexicon() if lexicon is None else lexicon)
    kind = docs.schema["doc_id"].dataType.simpleString()
    column = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, byte_fallback)
        for ids, texts in chunks(batches):
            got = counter.totals(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, column), pa.array([n for n, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
