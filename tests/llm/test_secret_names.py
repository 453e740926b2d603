"""Secrets whose names or sizes once kept them from being found."""

import time

import pytest

from tidemeter.llm import secrets


def literals(text):
    return [text[a:b] for a, k, b in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize("word", sorted(secrets.QUALIFIERS))
def test_each_qualifier_in_a_text_without_other_stems(word):
    for name in (f"{word}_key", f"{word}-key", f"{word}Key", f"{word.title()}Key", f"{word}.KEY"):
        text = f'{name} = "q8W3e0R5tYz"'
        # the base pattern takes api_key and apiKey with their values
        assert any("q8W3e0R5tYz" in text[a:b] for a, _, b in secrets.scan(text))


def test_names_in_pieces():
    assert literals('to_ken = "q8W3e0R5tYz"') == ["q8W3e0R5tYz"]
    assert literals('table_kind = "q8W3e0R5tYz"') == []


def test_long_element():
    value = "aB3$xYz9" * 1000
    assert literals(f"<passphrase>{value}</passphrase>") == [value]


def test_constants_of_many_spans_and_long_values():
    lines = ['a = "old0Value!"'] + [f'p{i} = "xY{i}z!"' for i in range(100)] + ["a = " + " + ".join(f"p{i}" for i in range(100)), "pwd = a"]
    assert literals("\n".join(lines)) == [f"xY{i}z!" for i in range(100)]
    long = "aB3$xYz9" * 10000
    assert literals(f'a = "old0Value!"\na = "{long}"\npwd = a') == [long]
    assert literals(f'a = "{long}"\nb = "change_me"\npwd = a + b') == []


def test_sums_that_double():
    lines = ['x0 = "aB3$xYz9"'] + [f"x{i + 1} = x{i} + x{i}" for i in range(3000)] + ["pwd = x3000"]
    assert literals("\n".join(lines)) == ["aB3$xYz9"]


@pytest.mark.parametrize("part", ["a", "a=", "token=", "a[", "token:", "a ", " ", "='", "<pwd>", "'a' + ", "a: ", "<", "key="])
def test_long_chains_are_read_once(part):
    spent = []
    for n in (4000, 16000):
        text = 'password "' + part * (n // len(part))
        spent.append(min(timed(text) for _ in range(2)))
    assert spent[1] < 10 * spent[0] + 0.5


def timed(text):
    begun = time.process_time()
    secrets.scan(text)
    return time.process_time() - begun


def test_bare_literal_of_many_signs():
    print_ = ":".join(["A7", "0f", "9C", "e1"] * 8)
    text = f"key_id: x\nprivate_key: {print_}\n"
    assert [text[a:b] for a, k, b in secrets.scan(text) if k == "literal"] == [print_]
    chain = "&".join(f"k{i}=v{i}" for i in range(100)) + "&token=Zx9Qw3Er7Ty1Uo5P"
    assert [chain[a:b] for a, k, b in secrets.scan(chain)] == ["token=Zx9Qw3Er7Ty1Uo5P"]


@pytest.mark.parametrize("n", [64, 5000])
@pytest.mark.parametrize("name", ["passphrase: ", "encryption_key:", "pwd="])
def test_bare_literal_of_many_pairs_is_one_span(spark, name, n):
    value = ":".join(f"{i * 37 % 256:02x}" for i in range(n))
    text = f"{name}{value} end"
    assert (len(name), "literal", len(name) + len(value)) in secrets.scan(text)
    (row,) = secrets.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == f"{name}[SECRET] end"


def test_many_base_spans_and_long_chains_in_linear_time():
    for text in ("\n".join(f'password = "q8W3e0R5tYz{i}"' for i in range(33_000)), "pwd=q8W3e0:" * 90_000, "passphrase: " + "a1:" * 300_000):
        began = time.time()
        secrets.scan(text[: 1 << 20])
        assert time.time() - began < 15


def plain_strength(text, spaced=False):
    from collections import Counter
    from math import log2
    import re

    if len(text) < 8 or (not spaced and any(c.isspace() for c in text)) or secrets.PLACEHOLDERS.search(text):
        return 0.0
    entropy = -sum(k / len(text) * log2(k / len(text)) for k in Counter(text).values())
    kinds = sum(bool(re.search(p, text)) for p in secrets.KIND_SIGNS)
    return min(1.0, entropy / 4) * (0.5 if kinds == 1 else 0.8 if kinds == 2 else 1.0)


def test_long_values_are_judged_as_short_ones(monkeypatch):
    import random

    rng = random.Random(11)
    signs = ["x", "X", "*", ".", "<", ">", "${", "}", "%(", ")s", "{{", "}}", "changeme", "change", "_me", "your", "_", "dumm", "y", "aB3", "q8W", "é", "none", "123"]
    monkeypatch.setattr(secrets, "WHOLE", 6)
    for _ in range(3000):
        parts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.3:
            parts = [rng.choice(["x", "*", ".", "<a", "${b"]) * rng.randint(1, 4)] + parts[1:] * 0 + [rng.choice(["x", "*", ".", "a>", "b}"]) * rng.randint(1, 4)]
        text = "".join(parts)
        want = plain_strength(text)
        assert abs(secrets.strength(secrets.Value.of([secrets.Value(p) for p in parts])) - want) < 1e-9, text
        assert abs(secrets.strength(secrets.Value(text)) - want) < 1e-9, text
    for text in ("pwd=aB3xy=q8W:zz=changeme=k1:Zé9", "k=xxxx:xxxxxxxxxx", "a=${b:cD9}"):
        run = secrets.Run(text, 0, len(text))
        for at in range(len(text)):
            value = run.value(at)
            assert abs(secrets.strength(value) - plain_strength(text[at:])) < 1e-9, text[at:]
            assert value.whole() == text[at:] and value.counts() == secrets.Counter(text[at:])


def test_phrases_may_have_spaces():
    assert literals('passphrase = "Correct horse Battery staple 91"') == ["Correct horse Battery staple 91"]
    assert literals('password_hint = "Correct horse Battery staple 91"') == []
    assert literals('session_key = "not a key at all, just words 91"') == []
