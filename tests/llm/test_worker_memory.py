"""What the operators keep in a worker process."""

import tracemalloc

import numpy as np

from repograph.llm import held
from repograph.llm.language_id import Parser, parser_table, suffix_automaton


def _table(automaton):
    """The table of `parser_table` in the words of its docstring."""
    states, letters = automaton.shape
    out = np.zeros(automaton.shape, np.int64)
    for s in range(states):
        for c in range(letters):
            to, fresh = automaton[s, c], automaton[0, c]
            ended = 0 if to >= 0 else (1 if s == 0 or fresh >= 0 else 2)
            out[s, c] = s * letters * 4 if c == 0 else (to if to >= 0 else max(fresh, 0)) * letters * 4 + ended
    return out.ravel()


def test_parser_table_holds_little_more_than_itself():
    codes = np.random.default_rng(3).integers(1, 20, 3000).tolist()
    automaton = suffix_automaton(codes, 24)
    tracemalloc.start()
    table = parser_table(automaton)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.dtype == np.int32 and np.array_equal(table, _table(automaton))
    assert peak < 2 * table.nbytes


def test_what_other_work_kept_is_dropped():
    samples = {"a": ["one two"], "b": ["drei vier"]}
    parser = Parser.shared(samples)
    assert Parser.shared(samples) is parser
    held.tables("toxicity")
    assert Parser.shared(samples) is not parser
