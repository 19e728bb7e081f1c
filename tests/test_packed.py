"""Packed values: vectorised masks against the character scan, and the defined results."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.operators.packed import _scan_exact, split_array, split_packed

CASES = {
    "": [], "  ": [], ",;|": [], "a": ["a"], "a,b": ["a", "b"], '"a, b";c': ["a, b", "c"], "Group:Drivers' Desk|x": ["Group:Drivers' Desk", "x"], '["a", "b"]': ["a", "b"], '{x,"y z"}': ["x", "y z"],
    'Group:"Desk ""Delta""", x': ['Group:Desk "Delta"', "x"], "'Group:Desk \"Delta\"', V\\b": ['Group:Desk "Delta"', "V\\b"], '"",x': ["x"], "a,,a;": ["a", "a"], '"abc': ['"abc'], "\xa0a ; b\xa0": ["a", "b"],
    '{"Group:Desk \\"Delta\\"",b}': ['Group:Desk "Delta"', "b"], "ä|ß\tü": ["ä", "ß", "ü"],
}


def test_cases():
    got = split_array(pa.array(list(CASES))).to_pylist()
    assert dict(zip(CASES, got)) == CASES
    assert [_scan_exact(c) for c in CASES] == list(CASES.values())


def test_null_and_empty_batch():
    assert split_array(pa.array([None, "a"], pa.string())).to_pylist() == [[], ["a"]]
    assert split_array(pa.array([], pa.string())).to_pylist() == []


word = st.text(alphabet="abä& -/", min_size=1, max_size=6).map(str.strip).filter(bool)
plain = st.one_of(word, st.builds(lambda w: f'"{w}"', word), st.builds(lambda w: f'Group:"{w}"', word), st.builds(lambda a, b: f'"{a}, {b}"', word, word))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(plain, max_size=5).flatmap(lambda vs: st.lists(st.sampled_from([",", ";", " | ", "\t", " ,; "]), min_size=len(vs), max_size=len(vs)).map(lambda ds: "".join(v + d for v, d in zip(vs, ds)))), min_size=1, max_size=8))
def test_masks_equal_scan(strings):
    assert split_array(pa.array(strings, pa.string())).to_pylist() == [_scan_exact(s) for s in strings]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a,b", "z"), (2, None, "z"), (3, "c", "z"), (3, "c", "z"), (4, "x" * 100_000 + ";y", None)], "id long, packed string, val string")
    assert sorted((r.row_id, r.pos, len(r.val)) for r in split_packed(df, "id", "packed").collect()) == [(1, 1, 1), (1, 2, 1), (3, 1, 1), (3, 1, 1), (4, 1, 100_000), (4, 2, 1)]
    assert {r.row_id for r in split_packed(df, "id", "packed", least=2).collect()} == {1, 4}
    assert split_packed(df.limit(0), "id", "packed").count() == 0
