"""Dropping lines that match any of many patterns."""

from __future__ import annotations

import logging
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.patterns import balanced, literal, to_automaton, to_jvm

log = logging.getLogger(__name__)
#: Patterns joined to one alternation; longer ones fall out of the JIT's favour.
CHUNK = 100
#: From so many expressions, or unanchored literals, on, those that are regular are scanned for
#: by automata, each of AUTOMATON_SIZE patterns, whose time does not grow with their number.
SCAN_FROM, AUTOMATON_SIZE = 6, 1000
#: From so many literals on, they have an automaton of their own.
LITERALS_FROM = 2000


@dataclass
class Blocklist:
    """Patterns sorted by how they are checked.

    Anchored literals (the usual ``^host,`` patterns) become set lookups of the line's
    first characters, one per distinct length; literals become substring checks; the rest
    is joined to alternations, by the JVM's matcher if they are few, else by one that
    runs in linear time.
    """

    prefixes: dict[int, list[str]] = field(default_factory=lambda: defaultdict(list))
    literals: list[str] = field(default_factory=list)
    expressions: list[str] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, lines: Iterable[str]) -> Blocklist:
        """From lines of text; blank lines and ``#`` comments are no patterns, white space
        in a pattern counts, and an invalid pattern is skipped with a warning."""
        found = cls()
        for line in lines:
            pattern = line.rstrip("\r\n")
            if not pattern.strip() or pattern.lstrip().startswith("#"):
                continue
            pattern = balanced(pattern)
            try:
                re.compile(re.sub(r"\[:\w+:\]", "a", pattern))
            except re.error as e:
                log.warning("pattern skipped: %r (%s)", pattern, e)
                found.rejected.append(pattern)
                continue
            plain = literal(pattern)
            if plain is None:
                found.expressions.append(pattern)
            elif plain[0]:
                found.prefixes[len(plain[1])].append(plain[1])
            else:
                found.literals.append(plain[1])
        return found

    def __len__(self) -> int:
        return sum(map(len, self.prefixes.values())) + len(self.literals) + len(self.expressions)

    def conditions(self, column: str) -> list[F.Column]:
        """Any of them true: the line is blocked.  Cheap ones come first."""
        value = F.col(column)
        found = [F.left(value, F.lit(n)).isin(texts) for n, texts in sorted(self.prefixes.items())]
        if len(self.literals) < SCAN_FROM:
            found += [value.contains(text) for text in self.literals]
        backtracked = self.expressions if len(self.expressions) < SCAN_FROM else [p for p in self.expressions if to_automaton(p) is None]
        for i in range(0, len(backtracked), CHUNK):
            found.append(value.rlike("|".join(f"(?:{to_jvm(p, unicode=False)})" for p in backtracked[i : i + CHUNK])))
        return found

    def scanned(self) -> tuple[list[str], list[str]]:
        """What Arrow batches are scanned for instead: literals, and alternations."""
        regular = [] if len(self.expressions) < SCAN_FROM else [x for x in map(to_automaton, self.expressions) if x is not None]
        own = self.literals if len(self.literals) >= LITERALS_FROM else []
        if SCAN_FROM <= len(self.literals) < LITERALS_FROM:
            regular += map(re.escape, self.literals)
        alternations = ["|".join(f"(?:{x})" for x in regular[i : i + AUTOMATON_SIZE]) for i in range(0, len(regular), AUTOMATON_SIZE)]
        return own, alternations

    def matches(self, column: str = "value") -> F.Column:
        conditions = self.conditions(column)
        return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def apply_blocklist(lines: DataFrame, blocklist: Blocklist, column: str = "value") -> DataFrame:
    """Lines that no pattern matches; case counts and the whole line is searched.

    Null lines stay.
    """
    kept = lines.where(~F.coalesce(blocklist.matches(column), F.lit(False)))
    literals, alternations = blocklist.scanned()
    if literals or alternations:
        kept = kept.mapInArrow(_scan(literals, alternations, column), kept.schema)
    return kept


def blocklist_report(lines: DataFrame, blocklist: Blocklist, column: str = "value") -> DataFrame:
    """One row: ``n_lines, n_kept, n_blocked``."""
    kept = apply_blocklist(lines, blocklist, column).agg(F.count("*").alias("n_kept"))
    total = lines.agg(F.count("*").alias("n_lines"))
    both = total.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one")
    return both.select("n_lines", "n_kept", (F.col("n_lines") - F.col("n_kept")).alias("n_blocked"))


def _scan(literals: list[str], alternations: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        if literals:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for text in literals:
                machine.add_word(text, True)
            machine.make_automaton()
        for batch in batches:
            for alternation in alternations:
                blocked = pc.fill_null(pc.match_substring_regex(batch[column], alternation), False)
                batch = batch.filter(pc.invert(blocked))
            if machine is not None:
                clean = [text is None or next(machine.iter(text), None) is None for text in batch[column].to_pylist()]
                batch = batch.filter(pa.array(clean, pa.bool_()))
            yield batch

    return run
