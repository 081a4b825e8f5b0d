"""Index normalisation, checked against what Python lists do with the same index."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cellweave.functions.index import normalize_column_indices, normalize_row_indices, validate_column_indices, validate_row_indices

LETTERS = ["delta", "alpha", "omega", "alpha", "kappa", "sigma", "tau"]
sizes = st.integers(1, 60)


@st.composite
def positions(draw):
    """(size, some valid positions, negative ones and repeats among them)."""
    n = draw(sizes)
    return n, draw(st.lists(st.integers(-n, n - 1), max_size=30))


def both(index, n):
    """The answer for rows, which is that for columns too."""
    got = list(normalize_row_indices(index, n))
    assert got == list(normalize_column_indices(index, n))
    return got


@given(positions())
def test_positions_in_any_container(case):
    n, wanted = case
    expected = sorted({range(n)[i] for i in wanted})
    containers = [wanted, tuple(wanted), np.array(wanted, np.int64), pd.Series(wanted, dtype="int64"), pd.Index(np.array(wanted, np.int32)), [float(i) for i in wanted], iter_list(wanted)]
    assert all(both(c, n) == expected for c in containers)


def iter_list(values):
    return [np.int16(v) for v in values]


@given(positions())
def test_single_positions(case):
    n, wanted = case
    for i in wanted:
        assert both(i, n) == both(np.int32(i), n) == both(float(i), n) == [range(n)[i]]


@given(sizes, st.none() | st.integers(-80, 80), st.none() | st.integers(-80, 80), st.sampled_from([None, 1]))
def test_slices_follow_lists(n, start, stop, step):
    s = slice(start, stop, step)
    assert both(s, n) == list(range(n))[s]


@given(st.lists(st.booleans(), min_size=1, max_size=60))
def test_masks(mask):
    expected = [i for i, hit in enumerate(mask) if hit]
    assert both(mask, len(mask)) == both(np.array(mask), len(mask)) == both(pd.Series(mask), len(mask)) == expected
    for other in (len(mask) + 1, len(mask) + 13):
        with pytest.raises(ValueError, match="Boolean index length"):
            normalize_row_indices(mask, other)


@given(sizes, st.integers(0, 9), st.booleans())
def test_positions_outside(n, beyond, below):
    bad = -n - 1 - beyond if below else n + beyond
    for index in (bad, [bad], np.array([bad]), [n - 1, bad, float(bad)]):
        with pytest.raises(IndexError):
            both(index, n)


@pytest.mark.parametrize("bad", [2.25, [3, 0.75], "word", b"word", None, False, [[2, 3], [4, 5]], {"k": 1}])
def test_other_types(bad):
    with pytest.raises((TypeError, IndexError)):
        normalize_row_indices(bad, 17)


@given(sizes, st.integers(2, 9))
def test_steps(n, step):
    for sign in (1, -1):
        with pytest.raises(ValueError, match="Step slicing"):
            both(slice(None, None, sign * step), n)


def test_long_ranges_stay_ranges():
    everything = normalize_row_indices(slice(None), 10**12)
    assert isinstance(everything, range) and len(everything) == 10**12
    assert len(normalize_row_indices(slice(-7, None), 10**15)) == 7


@given(st.lists(st.sampled_from(sorted(set(LETTERS))), max_size=9))
def test_names_stand_for_their_first_place(names):
    first = {n: LETTERS.index(n) for n in LETTERS}
    expected = sorted({first[n] for n in names})
    if names:
        assert list(normalize_column_indices(names, len(LETTERS), LETTERS)) == list(normalize_column_indices(np.array(names), len(LETTERS), LETTERS)) == expected
    for name in names:
        assert list(normalize_column_indices(name, len(LETTERS), LETTERS)) == [first[name]]


@given(st.none() | st.sampled_from(sorted(set(LETTERS))), st.none() | st.sampled_from(sorted(set(LETTERS))))
def test_slices_of_names_include_their_end(start, stop):
    lo = 0 if start is None else LETTERS.index(start)
    hi = len(LETTERS) if stop is None else LETTERS.index(stop) + 1
    assert list(normalize_column_indices(slice(start, stop), len(LETTERS), LETTERS)) == list(range(lo, hi))


def test_names_that_do_not_fit():
    for index in ("zeta", ["tau", "zeta"], slice("zeta", None), slice(None, "zeta")):
        with pytest.raises(IndexError, match="not found.*zeta|zeta.*not found"):
            normalize_column_indices(index, len(LETTERS), LETTERS)
    for index in ("tau", ["tau"], slice("tau", None)):
        with pytest.raises(ValueError, match="requires gene_names"):
            normalize_column_indices(index, len(LETTERS))
    with pytest.raises(TypeError):
        normalize_column_indices(["tau", 2], len(LETTERS), LETTERS)


@given(positions())
def test_validation(case):
    n, wanted = case
    for check in (validate_row_indices, validate_column_indices):
        check([], n)
        check(sorted({i % n for i in wanted}), n)
        check(range(n), n)
        for bad in ([n], [-1], range(n + 1)):
            with pytest.raises(IndexError):
                check(bad, n)
