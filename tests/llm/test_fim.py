import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from metergrid.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from(list("ab \n\té<PSM>\x1f\x85\U0001f600")), max_size=200)


def plain_rule(text, i, rate=50, spm=80):
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(0, 10**6))
def test_transform_and_inverse(text, i):
    found = fim.transform(text, i, 42, 100, 50)
    assert found == plain_rule(text, i, 100, 50)
    assert fim.restore(found[4], found[1]) == text


def test_ropes_of_many_leaves():
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "\n", "é", "x" * 40]) for _ in range(60_000)) + "  "
    units = UNITS.findall(text)
    tree = fim.rope(text)
    assert (tree.units, tree.chars, fim.written(tree)) == (len(units), len(text), text) and tree.depth <= 12
    for rank in [0, 1, 255, 256, 257, len(units) - 1, len(units), *(rng.randrange(len(units)) for _ in range(50))]:
        first, rest = fim.split_units(tree, rank)
        assert (fim.written(first), fim.written(rest)) == ("".join(units[:rank]), "".join(units[rank:]))
        assert (first.units, rest.units, first.chars) == (rank, len(units) - rank, len(fim.written(first)))
        whole = fim.concat(rest, first)
        assert fim.written(whole) == "".join(units[rank:] + units[:rank]) and whole.depth <= 20
        at = rng.randrange(len(text))
        assert tuple(map(fim.written, fim.split_chars(tree, at))) == (text[:at], text[at:])


def test_long_texts_take_a_moment():
    for text in ("word " * 2_000_000, " " * 5_000_000, "x" * 5_000_000):
        n, form, _, _, output = fim.transform(text, 1, 42, 100, 80)
        assert n == len(UNITS.findall(text)) and fim.restore(output, form) == text


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "one", "a b c d", "has <M> in it", "  ", "é x\n", "a b c d"])] + [(3, "a b c d"), (None, "null id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS form", "doc_id AS n", "'x' AS restored")
    made = fim.restored(fim.fill_in_middle(docs, rate=100))
    assert sorted(made.columns) == sorted(["doc_id", "text", "form", "n", "restored", "prefix_chars", "middle_chars", "output"])
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_rule(r["text"] or "", "" if r["doc_id"] is None else r["doc_id"], 100)
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == want and r["restored"] == (r["text"] or "")
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([("no sentinel", "psm"), (None, "spm"), ("x", None)], "output string, form string")
    assert [r["restored"] for r in fim.restored(odd).collect()] == [None, None, "x"]
