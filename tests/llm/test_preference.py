import random

import pytest

from classlake.llm import preference as P


def brute(chosen, rejected):
    def side(turns):
        return [(r or "", t or "") for _, r, t in sorted(
            ((n, r or "", t or "") for n, r, t in turns), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))]

    def completion(turns):
        out, spans = "", []
        for r, t in turns:
            out += f"<|im_start|>{r}\n"
            if r == "assistant":
                spans.append(f"{len(out)}-{len(out) + len(t) + 10}")
            out += f"{t}<|im_end|>\n"
        return out, ",".join(spans)

    rows = []
    for pair in {*chosen, *rejected}:
        a, b = side(chosen.get(pair, [])), side(rejected.get(pair, []))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        rows.append((pair, n, completion(a[:n])[0], *completion(a[n:]), *completion(b[n:])))
    return sorted(rows)


@pytest.fixture
def turns(spark):
    return lambda by: spark.createDataFrame(
        [(p, *t, "x", 1) for p, ts in by.items() for t in ts], "pair_id long, turn long, role string, text string, prompt string, at long")


def test_against_brute_force(turns):
    rng = random.Random(3)
    chosen, rejected = {}, {}
    for p in range(60):
        talk = [(k, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "é中\U0001F600\n", "", None, "a" * 200])) for k in range(rng.randrange(9))]
        chosen[p] = talk + [(rng.randrange(9), "assistant", "tie")] * (p % 3)
        rejected[p] = [(k, r, "no" if rng.random() < 0.2 else t) for k, r, t in talk]
    chosen[100], rejected[101] = [(None, "user", "a"), (0, "assistant", "b")], [(1, "user", "x")]
    chosen[102] = rejected[102] = [(k, "user", f"turn {k}") for k in range(500)]
    want = brute({k: v for k, v in chosen.items() if v}, {k: v for k, v in rejected.items() if v})
    got = sorted(tuple(r) for r in P.preference_pairs(turns(chosen), turns(rejected)).collect())
    assert got == want and [r[1:] for r in got if r[0] == 102][0][2:] == ("", "", "", "")


def test_null_pairs_and_no_rows(turns):
    assert P.preference_pairs(turns({}), turns({})).collect() == []
    got = P.preference_pairs(turns({None: [(0, "user", "a")], 1: [(0, "user", "a")]}), turns({})).collect()
    assert [(r.pair_id, r.n_common, r.chosen, r.rejected) for r in got] == [(1, 0, "<|im_start|>user\na<|im_end|>\n", "")]


def test_contrasted(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "bye"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"),
            (2, 0, "user", "alone"), (2, 1, "assistant", "a2"), (4, 0, "user", "no answer"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in P.preference_pairs(*P.contrasted(df)).collect()}
    assert set(got) == {0, 1, 2} and got[0].prompt == "<|im_start|>user\nq<|im_end|>\n"
    assert "a0" in got[0].chosen and "a1" in got[0].rejected and "bye" not in got[0].chosen and got[2].rejected == ""
    a, b = map(int, got[0].rejected_spans.split("-"))
    assert got[0].rejected[a:b] == "a1<|im_end|>"
