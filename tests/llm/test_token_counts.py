import numpy as np
import pytest

from arborframe.llm import token_counts as tc


def test_spans_are_those_of_the_tokens(spark, edge, edge_rows, nothing):
    enc, lengths = tc.encoder(tc.VOCABULARY)
    got = tc.count_tokens(edge).toPandas()
    total = got.groupby("doc_id", dropna=False)["n_tokens"].sum()
    for i, text, *_ in edge_rows:
        ids = tc.encode(enc, text or "")
        assert enc.decode_bytes(ids.tolist()) == (text or "").encode() and lengths[ids].sum() == len((text or "").encode())
        if i in (3, 6, 8):
            assert total[i] == len(ids)
    assert (got["end_byte"] >= got["start_byte"]).all() and len(got[got["doc_id"] == 5]) == 1
    assert tc.count_tokens(nothing).count() == 0


@pytest.mark.parametrize("rule", ["start", "most", "share"])
def test_rules_by_brute_force(rule):
    r = np.random.default_rng(4)
    for _ in range(200):
        tokens = np.cumsum(r.integers(1, 6, r.integers(0, 12)))
        end = int(tokens[-1]) if len(tokens) else 0
        sections = np.append(np.sort(r.integers(0, end + 1, r.integers(0, 5))), end)
        want = np.zeros(len(sections))
        for a, b in zip(np.append(0, tokens[:-1]), tokens, strict=False):
            part = [len(set(range(a, b)) & set(range(x, y))) for x, y in zip(np.append(0, sections[:-1]), sections, strict=True)]
            if rule == "start":
                want[next(k for k, y in enumerate(sections) if y > a)] += 1
            elif rule == "most":
                want[int(np.argmax(part))] += 1
            else:
                want += np.array(part) / sum(part)
        got, _ = tc.allocate(tokens, sections, rule)
        assert np.allclose(got, want)


def test_fields(edge):
    got = tc.count_tokens(edge, fields=["lang", "source", "text"], rule="share").toPandas()
    assert set(got["section"]) == {"lang", "source", "text"} and len(got) == 3 * edge.count()
    with pytest.raises(ValueError, match="other"):
        tc.count_tokens(edge, rule="other")


def test_long_runs_are_encoded_whole():
    enc, lengths = tc.encoder(tc.VOCABULARY)
    r = np.random.default_rng(8)
    commas = ",".join(map(str, r.integers(0, 10**6, 8000)))
    letters = "".join(r.choice(list("etaoinshr"), 30_000))
    spaces = ["".join(r.choice(list(kinds), 20_000)) for kinds in (" ", "\n", " \n", " \t\n\u3000\xa0", "\u2003\x85 ")]
    texts = [commas, letters, "a " + commas + " b", "漢字仮名" * 5000, "\x1c" * 20_000]
    texts += [f"{a}{s}{b}" for s in spaces for a in ("", "x", "(", "it's") for b in ("", "y", " y", "\ny", "7", "'s", "!\n")]
    for text in texts:
        assert tc.encode(enc, text).tolist() == enc.encode_ordinary(text)
    for run in (" " * 2_000_000, "a" + "\n \t" * 700_000 + "b"):
        assert lengths[tc.encode(enc, run)].sum() == len(run)
