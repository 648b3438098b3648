import random
import re
import string

from millrace.llm import secrets


def base(text):
    kinds = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]
    spans = [(m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]
    return ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(spans))


def test_base_spans():
    r = random.Random(8)
    parts = ["password", "Secret", "apikey", "API_KEY", "token", "AKIA", ": ", "=", " = '", '"', " ", "\n", "é", "ab12", "0123456789abcdef", "ABCDEFGHIJ234567", "deadbeef" * 3, "x.y/z"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        got = secrets.spans(text)
        names = list(secrets.KINDS)
        assert ",".join(f"{names[k]}:{s}:{e}" for s, k, e in got if k < 3) == base(text)


def test_random_strings_are_found_and_words_are_not():
    r = random.Random(9)
    found = 0
    for _ in range(200):
        key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
        found += any(k == 3 for _, k, _ in secrets.spans(f"here it is {key} and so on"))
    assert found >= 180
    for word in ("internationalisationandlocalisation", "a_long_identifier_with_words", "CONSTANT_NAME_OF_SOMETHING", "zzzzzzzzzzzzzzzzzzzzzzzzzzzz", "--------------------------------", "donaudampfschifffahrtsgesellschaft", "path/to/some/module/with/parts"):
        assert secrets.spans(f"see {word} there") == []


def test_false_discoveries_grow_no_faster_than_texts():
    r = random.Random(10)
    words = ["station", "kernel", "value", "module", "data", "index"]
    text = " ".join("".join(r.choice(words) for _ in range(4)) for _ in range(5000))
    assert secrets.spans(text) == []


def test_random_tokens_of_every_encoding_are_found():
    r = random.Random(11)
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for alphabet in (digits + "ABCDEF", low, up, up + "234567", low + "234567", low + digits, up + digits, low + up, low + up + digits, low + up + digits + "+/", low + up + digits + "-_"):
        for n in (20, 32, 64):
            found = sum(any(k == 3 for _, k, _ in secrets.spans(f"here it is {''.join(r.choice(alphabet) for _ in range(n))} and so on")) for _ in range(200))
            assert found >= 165, (alphabet, n, found)


def test_long_words_and_names_are_not_found():
    for word in ("lentokonesuihkuturbiinimoottori", "rechtsschutzversicherungsgesellschaften", "getHTTPResponseCodeFromURLv2", "RINDFLEISCHETIKETTIERUNGSUEBERWACHUNG", "anticonstitutionnellement2023", "zhonghuarenmingongheguo"):
        assert secrets.spans(f"see {word} there") == []


def controlled(items, rate):
    """Step-up control, written apart: the largest k of which the k-th weighted p-value is at most rate k / m."""
    m = len(items)
    mean = sum(n for _, n in items) / m if m else 0
    p = sorted((min(1.0, x * mean / n), i) for i, (x, n) in enumerate(items))
    k = m
    while k and p[k - 1][0] > rate * k / m:
        k -= 1
    return {i for _, i in p[:k]}


def tail(x, df):
    """P(chi-squared > x), by summing the incomplete gamma series."""
    import math

    a, z = df / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
    return 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 1.0


def test_p_values_and_discoveries_against_other_code():
    import math

    r = random.Random(12)
    tokens = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (20, 24, 32, 40, 64) for _ in range(8)]
    tokens += ["".join(r.choice(["data", "index", "Value", "module", "station"]) for _ in range(n)) for n in (5, 6, 8) for _ in range(6)]
    for t in tokens:
        name, as_random, _ = secrets.battery(t)
        symbols = secrets.ALPHABETS[name]
        n, k = len(t), len(symbols)
        x = sum((t.count(c) - n / k) ** 2 / (n / k) for c in symbols)
        uniform = tail(x * n / (n - 1), (k - 1) * n / (n - 1))
        up = [symbols.index(c) * 2 >= k for c in t]
        a, b = sum(up), n - sum(up)
        mean = 2 * a * b / n + 1
        z = (1 + sum(p != q for p, q in zip(up, up[1:])) - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))
        ranks = [symbols.index(c) for c in t]
        centre = sum(ranks) / n
        corr = sum((p - centre) * (q - centre) for p, q in zip(ranks, ranks[1:])) / sum((p - centre) ** 2 for p in ranks)
        ps = [uniform, math.erfc(abs(z) / math.sqrt(2)), math.erfc(abs(corr + 1 / n) * math.sqrt(n / 2))]
        want = tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 6)
        assert abs(as_random - want) < 0.02 or abs(math.log(max(as_random, 1e-30) / max(want, 1e-30))) < 1, t
    text = " ".join(tokens)
    each = [secrets.battery(t) for t in tokens]
    gone = controlled([(p, len(t)) for (_, p, _), t in zip(each, tokens)], secrets.NOT_RANDOM)
    found = controlled([(1.0 if i in gone else p, len(t)) for i, ((_, _, p), t) in enumerate(zip(each, tokens))], secrets.DISCOVERY_RATE) - gone
    assert {text[s:e] for s, k, e in secrets.spans(text) if k == 3} == {tokens[i] for i in found}
    assert gone and len(found) >= 30
