import math
import random
import re
import time

from tsengine.llm import secret_scan as s

ASSIGN = re.compile(r"""(?:(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def bits(w):
    return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))


def every(text):
    known = base(text)
    out = list(known)
    for rank, (kind, pattern, least) in enumerate(s.CLASSES, 3):
        for m in re.finditer(pattern, text):
            w = m[0]
            allowed = [*s.ALLOWED, "^[0-9A-Fa-f]+$"] if kind == "entropy_base64" else ["^[0-9]+$", s.ALLOWED[-1]]
            if any(re.search(a, w) for a in allowed):
                continue
            at = [m.start() + i for i in range(len(w) - s.WIDTH + 1) if bits(w[i : i + s.WIDTH]) >= least]
            at = [i for i in at if not any(b[0] < i + s.WIDTH and i < b[2] for b in known)]
            spans = []
            for i in at:  # stretches that windows cover
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + s.WIDTH
                else:
                    spans.append([i, i + s.WIDTH])
            out += [(a, rank, b, kind) for a, b in spans]
    return sorted(out)


def check(small, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = s.scan_secrets(small(rows, "doc_id LONG, text STRING, found STRING, start INT")).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        assert [tuple(x) for x in r.base] == base(text), text
        assert [tuple(x) for x in r.found] == every(text), text


def test_planted(small):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzzQ9"
    hexes = "3f9a0c7d1e5b82466f0a9c3d7e1b5a28"
    check(small, [f"PassWord : '{key}' é{key}", "x" * 30_000 + f" token=abc secret=abcdef {hexes}", "AKIA" + "Q" * 15, "AKIA" + "Q7" * 8 + " AKIAQ", "password: token: abcdefgh", f"{hexes.upper()} {hexes[:20]} id 123e4567-e89b-12d3-a456-426614174000", f"a{key}+/{key}= {key}éé{key}", "some/path/to/a/file/that/is/long 01234567890123456789", "api_key==abcde apikey\"='abcdef", None, "", "plain", "😀 token=😀abcdef token=abcdef😀"])


def test_parts_outside_known_formats_are_found(small):
    r = random.Random(7)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    low = "aA" * 40
    texts = [f"{key(30)}{'AKIA' + 'Q7' * 10}+{key(30)}", f"{key(25)}{low}{key(25)}", f"{key(40)}/{'deadbeef' * 4}/{key(40)}", f"{key(19)}{'0f' * 12}{key(19)}", f"{key(20)}password={key(9)}/{key(20)} {key(30)}"]
    texts += ["".join(r.choice([key(3), key(22), "AKIA" + "Q7" * 9, "0f" * 13, "token=", "=", "aaaa", "_", " "]) for _ in range(14)) for _ in range(150)]
    check(small, texts)
    assert sum(len([x for x in every(t) if x[1] > 2]) for t in texts[:2]) == 4


def test_long_candidates_are_cut_where_no_window_is_lost(small):
    r = random.Random(8)
    letters = "ABCDEFGHabcdefgh0123456789+/"
    words = ["".join(r.choice(letters if r.random() < 0.5 else "aA") for _ in range(r.choice([19, 20, 500, 511, 512, 513, 530, 531, 532, 1023, 1024, 1043, 1600]))) for _ in range(60)]
    mixed = ["".join("".join(r.choice(letters) for _ in range(r.randrange(30))) + "aA" * r.randrange(30) for _ in range(40)) for _ in range(20)]
    check(small, words + mixed)


def test_random_keys_are_found(small):
    import numpy as np

    g = np.random.default_rng(9)
    for letters, kinds in (("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "entropy_base64"), ("0123456789abcdef".upper(), "entropy_hex")):
        for n in (20, 22, 24, 32, 40):
            keys = ["".join(letters[i] for i in g.integers(0, len(letters), n)) for _ in range(500)]
            got = s.scan_secrets(small([(i, f"key {k} end") for i, k in enumerate(keys)], "doc_id LONG, text STRING")).collect()
            assert sum(any(x.kind == kinds for x in row.found) for row in got) >= 0.95 * len(keys), (letters, n)


def test_time_grows_with_the_text(small):
    r = random.Random(10)
    base64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    for text, n in (("token=" * 350_000, 1), ("token=abcdef " * 100_000, 100_000), (base64, None), ("token=aB3dE6gH9jK2mN5pQ8sT " * 40_000, 40_000), ("aB3dE6gH9jK2mN5pQ8sT " * 40_000, 40_000)):
        begin = time.time()
        row = s.scan_secrets(small([(1, text)], "doc_id LONG, text STRING")).selectExpr("size(base) AS b", "size(found) AS f", "element_at(found, -1).stop AS last").first()
        assert (row.f == n if n else row.f < 50) and row.last and time.time() - begin < 120, (text[:30], row, time.time() - begin)


def test_random_texts(small):
    r = random.Random(2)
    bits_ = ["password", "Token", "apikey", "=", ": ", "'", '"', "AKIA", "AB12", "deadbeef", "0f", "Xy9", "/", "+", " ", "\n", "é", "zQ7kT2"]
    check(small, ["".join(r.choice(bits_) for _ in range(r.randrange(60))) for _ in range(400)])


def test_empty_and_native(small):
    df = s.digest(small([], "doc_id LONG, text STRING"))
    assert df.count() == 0
    plan = s.digest(small([(1, "x")], "doc_id LONG, text STRING"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
