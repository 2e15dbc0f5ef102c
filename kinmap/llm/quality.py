"""Line-first quality rules: lines are judged one by one, failing lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kinmap.llm.common import bounded_batches, slices
from kinmap.llm.words import Words, lines_of, split, sums, text_column, words_of

#: Fixed phrases (RE2, any case) of lines that say nothing of their document's subject.
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|released under the|copyright (?:\(c\)|©|[0-9]{4})|"
    r"privacy policy|cookie policy|(?:uses?|accept) cookies|terms of (?:use|service)|enable javascript|powered by|"
    r"click here|sign in|log in|subscribe (?:now|to)|share (?:on|this)|read more|lorem ipsum"
)
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›·•]"
MARKS = r"[.!?…]+"
ENDS = r"[.!?…:;\"'”’»)\]]$"


@dataclass(frozen=True)
class Rules:
    """Production values. A line is judged by its words, marks (runs of sentence marks), separators and symbols."""

    words_for_marks: int = 40  # a line without an end mark needs one sentence mark for so many words
    marks_percent: int = 50  # more marks than this for 100 words: shouting
    symbols_percent: int = 20  # more symbols than this for 100 words: decoration
    separators: int = 3  # so many separators, and ...
    separators_percent: int = 20  # ... this many for 100 words: navigation
    lost_percent: int = 50  # a document may lose so much of its lines' characters
    min_words: int = 50
    repeat_percent: int = 50


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_lines_removed long, line_chars long, lost_chars long, base_failed boolean, kept boolean"


def count(column: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(column, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_words(words: Words) -> np.ndarray:
    """For each row, the words that lie in a 3-word window found twice or more in the row."""
    codes, rows, n = words.codes, words.rows, len(words.codes)
    covered = np.zeros(n, bool)
    if n >= 3:
        at = np.flatnonzero(rows[2:] == rows[:-2])
        size = max(len(words.vocabulary), 1)
        if size**3 * (int(rows[-1]) + 1) < 2**62:
            keys = ((rows[at] * size + codes[at]) * size + codes[at + 1]) * size + codes[at + 2]
        else:  # rank the pairs, then the triples, so that keys stay exact in 64 bits
            pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)[1]
            triples = np.unique(pairs[at] * size + codes[at + 2], return_inverse=True)[1]
            keys = rows[at] * (int(triples.max(initial=0)) + 1) + triples
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for shift in range(3):
            covered[at[twice] + shift] = True
    return sums(covered, words.offsets)


def failing_lines(lines: pa.Array, rules: Rules = Rules()) -> np.ndarray:
    """True for lines that a punctuation, navigation or boilerplate rule fails."""
    n = np.maximum(words_of(lines).counts, 1)
    marks, separators, symbols = count(lines, MARKS), count(lines, SEPARATORS), count(lines, SYMBOLS)
    ended = pc.match_substring_regex(pc.ascii_trim_whitespace(lines), ENDS).to_numpy(zero_copy_only=False)
    punctuation = (~ended & (marks * rules.words_for_marks < n)) | (100 * marks > rules.marks_percent * n) & (n > 3) | (100 * symbols > rules.symbols_percent * n)
    navigation = (separators >= rules.separators) & (100 * separators >= rules.separators_percent * n)
    boilerplate = pc.match_substring_regex(lines, BOILERPLATE).to_numpy(zero_copy_only=False)
    return punctuation | navigation | boilerplate


def judge(texts: pa.Array, rules: Rules = Rules()) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The figures of each text, and the texts without their failing lines."""
    words = words_of(texts)
    n_words = words.counts
    lengths = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    split_lines = lines_of(texts)
    all_lines = split(split_lines)  # empty lines have no word
    has_word = words_of(all_lines.vocabulary).counts > 0
    bad = failing_lines(all_lines.vocabulary, rules) & has_word
    size = pc.utf8_length(all_lines.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, real = all_lines.codes, has_word[all_lines.codes]
    keys = all_lines.rows * max(len(has_word), 1) + codes
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    out = {
        "n_words": n_words,
        "word_chars": sums(lengths[words.codes], words.offsets),
        "n_symbols": count(texts, SYMBOLS),
        "n_dup_lines": sums(real & ~first, all_lines.offsets),
        "n_repeat_words": repeated_words(words),
        "n_lines": sums(real, all_lines.offsets),
        "n_lines_removed": sums(bad[codes], all_lines.offsets),
        "line_chars": sums(size[codes] * real, all_lines.offsets),
        "lost_chars": sums(size[codes] * bad[codes], all_lines.offsets),
    }
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * n_words)
    out["kept"] = ~out["base_failed"] & (100 * out["lost_chars"] <= rules.lost_percent * out["line_chars"])
    flat, ends = split_lines.flatten(), split_lines.offsets.to_numpy()
    drop = np.isin(pc.index_in(flat, all_lines.vocabulary.filter(pa.array(bad))).fill_null(-1).to_numpy(zero_copy_only=False), [-1], invert=True)
    stay = np.concatenate(([0], np.cumsum(~drop)))
    cleaned = pc.binary_join(pa.ListArray.from_arrays(pa.array(stay[ends - ends[0]], pa.int32()), flat.filter(pa.array(~drop))), "\n")
    return out, cleaned


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row a document: ``key``, its figures, ``kept`` and, if asked for, ``clean_text`` without failing lines.

    No shuffle; whole texts in slices of bounded size. Null and empty texts have no words and fail the base rules; null keys
    and repeated rows come back as they are; extra columns are not read. Lines are split at ``\\n``; a line without a word is
    never removed and never counted.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {SCHEMA}" + ", clean_text string" * with_text
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            figures, cleaned = judge(text_column(batch.column("_text")), rules)
            columns = [batch.column("_key"), *(pa.array(figures[n]) for n in names), *[cleaned] * with_text]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *names, *["clean_text"] * with_text])

    return bounded_batches(docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text")).mapInArrow(run, schema)
