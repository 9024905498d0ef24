"""License scan by template-markup matching.

A template is wording with two kinds of markup: ``[[ ... ]]`` is a region that may be missing, and ``{{n}}`` one of up to n words of any
kind. It is compiled into an automaton over words, which accepts a place of a text only if all mandatory wording is there,
word for word. A template is tried on texts only that have its trigger, one of its mandatory words, as a word; one search of the bytes finds those.

Defined cases: A-Z is lower-cased; words are runs of ASCII letters, digits and all characters beyond ASCII; a null text is
empty; rows are judged each for itself, whatever their doc_id; a very long text is one chunk of its own and takes memory in proportion to its length; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, spans

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Whole licences, with conditions and disclaimer.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in
all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or
otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution [[ [[3]] neither the name of {{12}}
nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission ]] this software is provided by {{12}} as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable
for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage"""
#: Notices and licences in markup; an ``-opening`` is a licence's first clause alone, which says nothing of the terms behind it; the label, the wording, and a mandatory word to search for.
TEMPLATES = [
    ("apache", "[[licensed under]] [[the]] apache license [[version]] [[2 0]]", "apache"),
    ("apache-2.0", "licensed under [[the terms of]] the apache license version 2 0 [[the license]]", "apache"),
    ("mit", "[[released]] [[licensed]] [[distributed]] under [[the terms of]] the mit license", "mit"),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("mit", MIT, "hereby"),
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted provided that", "redistribution"),
    ("bsd", BSD, "redistribution"),
    ("gpl-3.0", "[[this {{3}} is]] licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3", "gnu"),
    ("cc-by-nc", "[[licensed under]] [[a]] [[the]] cc by nc [[sa]] [[nd]] [[4 0]]", "nc"),
    ("cc-by-sa", "[[licensed under]] [[a]] [[the]] cc by sa [[4 0]]", "sa"),
    ("copyright", "copyright [[c]] {{8}} all rights reserved", "copyright"),
]


class Automaton:
    """States are places in the template; ``moves[s]`` are (word or None for any, next state), ``free[s]`` the states reached without a word."""

    def __init__(self, template: str):
        parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template)
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        opened, at = [], 0
        for p in parts:
            if p == "[[":
                opened.append(at)
            elif p == "]]":
                self.free[opened.pop()].append(at)
            elif p.startswith("{{"):
                states = [at] + [self._new() for _ in range(int(p[2:-2]))]
                for a, b in zip(states, states[1:]):
                    self.moves[a].append((None, b))
                    self.free[a].append(states[-1])
                at = states[-1]
            else:
                new = self._new()
                self.moves[at].append((p.encode(), new))
                at = new
        if opened:
            raise ValueError(f"a region is not closed: {template}")
        self.final = at
        self.start = self.closed({0})
        self.first = {w for s in self.start for w, _ in self.moves[s]}

    def _new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: list[bytes], i: int) -> int:
        """The end of the longest accepted run from word ``i`` on, or ``i`` if none is."""
        now, end = set(self.start), i
        for j in range(i, len(words)):
            now = self.closed({t for s in now for w, t in self.moves[s] if w is None or w == words[j]})
            if not now:
                break
            if self.final in now:
                end = j + 1
        return end

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        out, i = [], 0
        while i < len(words):
            end = self.longest(words, i) if None in self.first or words[i] in self.first else i
            if end > i:
                out.append((i, end))
                i = end
            else:
                i += 1
        return out


def _scan(phrases: dict[str, str], templates: list[tuple[str, str, str]]):
    found = [(label, len(p.split()), re.compile(GAP.join(map(re.escape, p.encode().split())))) for p, label in phrases.items()]
    automata = [(label, Automaton(t)) for label, t, _ in templates]
    # No trigger begins with another, or the other alone would be found where both are; overlaps within one word make no word.
    trigger = re.compile(b"|".join(sorted({re.escape(t.encode()) for _, _, t in templates}, reverse=True)))
    triggers = [t.encode() for _, _, t in templates]

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                low = LOWER[data]
                s, e, count = spans(low, off, WORD)
                raw, n = low.tobytes(), hi - lo
                total, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
                base, labels, covered = [set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
                for label, size, pattern in found:
                    for m in pattern.finditer(raw):
                        w = int(np.searchsorted(s, m.start()))
                        d = int(np.searchsorted(count, w, side="right")) - 1
                        if w + size <= count[min(d + 1, n)] and s[w] == m.start() and e[w + size - 1] == m.end():
                            at = w - int(count[d])
                            total[d] += 1
                            first[d] = at if first[d] is None else min(first[d], at)
                            last[d] = at if last[d] is None else max(last[d], at)
                            base[d].add(label)
                            covered[d].append((at, at + size))
                rows: dict[int, set[bytes]] = {}
                for m in trigger.finditer(raw):
                    w = int(np.searchsorted(s, m.start()))
                    if w < len(s) and s[w] == m.start() and e[w] == m.end():
                        rows.setdefault(int(np.searchsorted(count, w, side="right")) - 1, set()).add(m[0])
                for d, has in rows.items():
                    words = [raw[x:y] for x, y in zip(s[count[d] : count[d + 1]].tolist(), e[count[d] : count[d + 1]].tolist())]
                    for (label, automaton), t in zip(automata, triggers):
                        if t in has:
                            if hits := automaton.places(words):
                                labels[d].add(label)
                                covered[d] += hits
                n_words = np.diff(count)
                score = []
                for d in range(n):
                    end = share = 0
                    for x, y in sorted(covered[d]):
                        share += max(0, y - max(x, end))
                        end = max(end, y)
                    score.append(share / int(n_words[d]) if share else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[lo:hi], pa.array(n_words), pa.array(total), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels)]), pa.array(score, pa.float64())],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the share of words in matched wording."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(phrases, templates), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
