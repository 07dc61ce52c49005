"""Token counts of the sections of a document: one encoding, tokens joined to sections by offset.

The document is encoded whole. Each token's character span follows from the bytes its id stands
for; token spans and section spans, both rising, meet by binary search. A token over a boundary goes
where the rule says:

* `majority`: to the section with most of its characters, the earlier one of equals;
* `first`: to the section of its first character (or the first section it reaches);
* `share`: to each section by its share of the token's characters in sections.

Edge cases: a null or empty text has one section (0, 0) without tokens; tokens in no section are
counted under section -1; empty sections get none; a character split among several tokens counts
for each of them; repeated documents give their rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from condensq.llm.common import slices
from condensq.llm.encoding import VOCABULARY, encoder

RULES = ("majority", "first", "share")


def line_sections(text: str) -> np.ndarray:
    """(start, stop) of every line, its line feed included."""
    stops = np.cumsum([len(line) + 1 for line in text.split("\n")])
    stops[-1] -= 1
    return np.column_stack([np.concatenate([[0], stops[:-1]]), stops])


def token_spans(ids: np.ndarray, text: str, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 character of each token."""
    stop = np.cumsum(byte_lengths[ids])
    start = stop - byte_lengths[ids]
    if text.isascii():
        return start, stop
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return character[start], character[stop - 1] + 1


def attribute_spans(
    first: np.ndarray, last: np.ndarray, sections: np.ndarray, rule: str = "majority"
) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) for each section and, at the end, for none.

    `sections` are rising, disjoint (start, stop). A crossing token is counted where the rule puts
    it (`share`: where its first character is).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    n = len(sections)
    full = np.flatnonzero(sections[:, 1] > sections[:, 0])
    a, b = sections[full, 0], sections[full, 1]
    tokens, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    lo = np.searchsorted(b, first, "right")
    hi = np.searchsorted(a, last, "left") - 1
    inside = lo <= hi
    tokens[n] += np.count_nonzero(~inside)
    plain = inside & (lo == hi)
    np.add.at(tokens, full[lo[plain]], 1)
    for k in np.flatnonzero(inside & (lo < hi)):
        among = np.arange(lo[k], hi[k] + 1)
        overlap = np.minimum(b[among], last[k]) - np.maximum(a[among], first[k])
        home = among[np.argmax(overlap)] if rule == "majority" else among[0]
        crossing[full[home]] += 1
        if rule == "share":
            tokens[full[among]] += overlap / overlap.sum()
        else:
            tokens[full[home]] += 1
    return tokens, crossing


def section_tokens(
    docs: DataFrame,
    sections: Callable[[str], np.ndarray] = line_sections,
    rule: str = "majority",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, n_crossing): a row for each section.

    `sections` gives the rising, disjoint (start, stop) character spans of a text. n_tokens is a
    whole number unless the rule is `share`.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    names = ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        lengths = enc.byte_lengths()
        for batch in slices(batches, "text"):
            sizes, parts = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = np.asarray(sections(text), np.int64).reshape(-1, 2)
                ids = np.frombuffer(enc.encode(text), "<u4")
                first, last = token_spans(ids, text, lengths)
                tokens, crossing = attribute_spans(first, last, spans, rule)
                number = np.arange(len(spans))
                if tokens[-1]:
                    number, spans = np.append(number, -1), np.vstack([spans, [0, 0]])
                m = len(number)
                sizes.append(m)
                parts.append(np.column_stack([number, spans, tokens[:m], crossing[:m]]))
            table = np.concatenate(parts)
            docs_of = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            kinds = [np.int32, np.int64, np.int64, np.float64 if rule == "share" else np.int64, np.int64]
            yield pa.record_batch(
                [docs_of, *(pa.array(table[:, i].astype(k)) for i, k in enumerate(kinds))], names
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    count = "double" if rule == "share" else "long"
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, section int, start long, stop long, n_tokens {count}, n_crossing long"
    )
