import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablemend.llm import fill_middle as fim

from .conftest import frame, odd_rows

TEXT = st.text(alphabet=st.sampled_from("ab \n\r<PSM>éß漢😀\x00"), max_size=60)


def expected(i, text, seed=7, rate=100, spm=50, unit="line"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < spm else "psm"
    output = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return i, n, form, len(pre), len(mid), output


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_index_converts_every_cut_both_ways(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    index = fim.Exceptions.of(raw)
    chars = np.arange(len(text) + 1)
    at = np.array([len(text[:k].encode()) for k in chars])
    assert index.to_bytes(chars).tolist() == at.tolist()
    assert index.to_chars(at).tolist() == chars.tolist()
    assert len(index.chars) == sum(ord(c) > 127 for c in text)


@settings(max_examples=200, deadline=None)
@given(TEXT.filter(lambda t: not any(m in t for m in ("<P>", "<S>", "<M>"))), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.booleans(), st.sampled_from(["line", "char"]))
def test_outputs_come_apart_again(text, first, second, spm, unit):
    n, at, chars = fim.cut(np.frombuffer(text.encode(), np.uint8), first, second, unit)
    assert n == len(re.findall("[^\n]*\n|[^\n]+", text) if unit == "line" else text)
    assert text[: chars[0]].encode() == text.encode()[: at[0]] and text[: chars[1]].encode() == text.encode()[: at[1]]
    output = fim.put_together(text.encode(), at, spm)
    assert fim.take_apart(output, fim.SPM if spm else fim.PSM) == text.encode()


@pytest.mark.parametrize("options", [{}, {"unit": "char", "seed": 3}, {"rate": 40, "spm": 10}])
def test_odd_rows(spark, odd, options):
    found = fim.restore(fim.transform(odd, **options)).collect()
    want = [expected(i, t, **options) for i, t in odd_rows()]
    assert sorted(map(str, (tuple(r)[:6] for r in found))) == sorted(map(str, want))
    texts = sorted((str(i), t or "") for i, t in odd_rows())
    assert sorted((str(r.doc_id), r.restored) for r in found) == texts
    assert options.get("rate", 100) < 100 or {"psm", "spm", "plain"} <= {r.form for r in found}


def test_marks_keep_a_text_plain(spark):
    rows = [(i, t) for i, t in enumerate(["a<P>b", "<S>", "x\n<M>", "<p> < P> <PS>", "<<P", "<M", "P>"])]
    found = {r.doc_id: r for r in fim.restore(fim.transform(frame(spark, rows))).collect()}
    assert [found[i].form == "plain" for i in range(7)] == [True, True, True, False, False, False, False]
    assert all(found[i].restored == t for i, t in rows)


def test_empty_table_and_unknown_unit(none):
    assert fim.restore(fim.transform(none)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(none, unit="word")
