import random
import re

from webgauge.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(3)
    for alphabet in ["ab@.-1 ", "0123456789.", "+0123 ()-.", "0123456789- ", "a@b.c@d.e%+", "é@a.b1 .9+"]:
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == plain(text), text


def test_card_numbers_and_long_inputs():
    assert pii.base_spans("card 4111 1111-1111 1111 ok") == [("card", 5, 24)]
    assert pii.base_spans("0" * 5000 + ".1.1.255") == [("ip", 0, 5008)] and pii.base_spans("9" * 5000 + ".1.1.1") == []
    for text in ["1" * 300_000, "a" * 300_000 + "@", "." * 200_000 + "1.2.3.4", "@" * 100_000, "-" * 300_000, "ab12" * 100_000]:
        assert isinstance(pii.base_spans(text), list)
        pii.seed_contexts(text, [(a, b) for _, a, b in pii.base_spans(text)])
    assert pii.key_spans("k 0123456789abcdef0123456789abcdef. " + "f" * 40, []) == [(2, 34)]
    assert pii.key_spans("0123456789abcdef0123456789abcdef", [(30, 31)]) == []


def plain_bootstrap(texts):
    """The loop as the docstring of the module has it, over strings: the spans added to each text."""
    cores = []
    for t in texts:
        row = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
            c = re.search(r"[^\x00-/:-@\[-`{-\x7f](?:.*[^\x00-/:-@\[-`{-\x7f])?", m.group(), re.S)
            low = lambda s: "".join(x.lower() if x.isascii() else x for x in s)
            row.append((low(c.group()), m.start() + c.start(), m.start() + c.end(), m.start(), m.end()) if c else (low(m.group()), 0, 0, m.start(), m.end()))
        cores.append(row)

    def slots():
        for d, row in enumerate(cores):
            for i in range(len(row)):
                for n in range(1, 5):
                    if i + n <= len(row) and all(w[2] for w in row[i : i + n]):
                        yield d, i, n, tuple(w[0] for w in row[i : i + n])

    def contexts(d, i, n):
        row, j = [w[0] for w in cores[d]], i + n
        if i >= 1:
            yield ("l", n, row[i - 1])
        if i >= 2:
            yield ("ll", n, row[i - 2], row[i - 1])
        if j + 1 < len(row):
            yield ("rr", n, row[j], row[j + 1])
        if i >= 1 and j < len(row):
            yield ("lr", n, row[i - 1], row[j])

    everything = [(d, i, n, s, p) for d, i, n, s in slots() for p in contexts(d, i, n)]
    known = {}
    taken, keys = [], []
    for d, t in enumerate(texts):
        base = [(a, b) for _, a, b in plain(t or "")]
        keys.append(pii.key_spans(t or "", base))
        taken.append(base)
        for a, b in base + keys[d]:
            words = [k for k, w in enumerate(cores[d]) if w[3] < b and w[4] > a]
            if len(words) <= 4 and all(cores[d][k][2] for k in words):
                s = tuple(cores[d][k][0] for k in words)
                for p in contexts(d, words[0], len(words)):
                    known.setdefault(p, {}).setdefault(s, 0)
                    known[p][s] += 1
    accepted = set()
    for _ in range(pii.ROUNDS):
        backed = {p for p, s in known.items() if len(s) >= pii.SUPPORT}
        total = {}
        for *_, p in everything:
            total[p] = total.get(p, 0) + 1
        precise = {p for p in backed if sum(known[p].values()) >= pii.PRECISION * total[p]}
        named = {s for of in known.values() for s in of}
        edges = {}
        for d, i, n, s, p in everything:
            if p in precise:
                edges.setdefault(p, {}).setdefault(s, 0)
                edges[p][s] += 1
        doubt, inside = {}, {}
        for p, of in edges.items():
            trust = sum(s in named for s in of) / (len(of) + 1)
            if trust >= pii.TRUST:
                for s, k in of.items():
                    if s not in named:
                        doubt[s] = doubt.get(s, 1) * (1 - min(trust, 0.999))
                        inside[s] = max(inside.get(s, 0), k)
        count = {}
        for *_, s in slots():
            count[s] = count.get(s, 0) + 1
        new = {s for s, x in doubt.items() if 1 - x >= pii.CONFIDENCE and (re.search("[0-9]", "".join(s)) or 2 * inside[s] >= count[s])}
        if not new:
            break
        accepted |= new
        for d, i, n, s, p in everything:
            if s in new:
                known.setdefault(p, {}).setdefault(s, 0)
                known[p][s] += 1
    out = []
    for d in range(len(texts)):
        found = [(cores[d][i][1], cores[d][i + n - 1][2]) for e, i, n, s in slots() if e == d and s in accepted]
        out.append(sorted(keys[d] + pii.chosen_spans(taken[d] + keys[d], found)))
    return out


GOOD = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "30000000000004"]


def planted():
    """Cards in one context; unseen numbers in it too, and in a second; words in the second, and in a third."""
    texts = [f"please quote card number {g} today" for g in GOOD] + [f"please quote card number {x}, today" for x in ("9999-8888-77x6", "A-1", "X77")]
    texts += [f"the member called {x} has left us" for x in ("9999-8888-77x6", "A-1", "X77", "Zeta", "Zeta")]
    texts += [f"welcome back dear {x} and friends" for x in ("Zeta", "A-1", "X77", "Kappa")]
    return texts + ["an order of 12345678 things", "the order has left", "numbers 7 and dear me", None, "", "x 1.2.3.4", "", "dear Kappa: 4111111111111111"]


def test_bootstrap_finds_unseen_identifiers_over_hops(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as key", "'x' as pattern")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    want = plain_bootstrap(texts)
    for k in range(len(texts)):
        spans = [f"{kind}:{a}:{b}" for kind, a, b in plain(texts[k] or "")] + [f"id:{a}:{b}" for a, b in want[k]]
        assert got[k].spans == ",".join(spans) and got[k].n_spans == len(spans) and got[k].n_added == len(want[k]), (texts[k], got[k].spans)
    found = {texts[k][a:b] for k in range(len(texts)) for a, b in want[k]}
    assert found == {"9999-8888-77x6", "A-1", "X77", "Zeta", "Kappa"}


def test_bootstrap_equals_the_plain_loop_on_noise(spark):
    rng = random.Random(11)
    words = ["of", "the", "is", "id:", "=", "ref", "(no)", "éa", "B7", "c9-d", "10.0.0.1", "10.0.0.2", "10.0.0.3", "a@b.cd", "e@f.gh", "+1 555 0142 22", "token", "0123456789abcdef0123456789abcdef"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    df = spark.createDataFrame([(k % 140, t) for k, t in enumerate(texts)] + [(None, texts[3]), (None, None)], "doc_id long, text string")
    want = plain_bootstrap([*texts, texts[3], None])
    expected = sorted((k % 140 if k < 150 else -1, ",".join([f"{x}:{a}:{b}" for x, a, b in plain(t or "")] + [f"id:{a}:{b}" for a, b in want[k]])) for k, t in enumerate([*texts, texts[3], None]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.spans) for r in pii.find_personal_data(df).collect()) == expected


def test_edge_cases(spark):
    df = spark.createDataFrame([(102, None), (103, ""), (None, "x 1.2.3.4"), (103, "")], "doc_id long, text string").selectExpr("*", "1 as n", "2 as key")
    got = pii.find_personal_data(df).collect()
    assert len(got) == 4 and sum(r.n_ip for r in got) == 1
    assert {r.base_sha256 for r in got if r.doc_id} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert pii.find_personal_data(df.limit(0)).count() == 0
