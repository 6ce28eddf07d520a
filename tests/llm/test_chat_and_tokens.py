import random
import re

import pytest

from querylens.llm import attribution, bpe, conversations


# ---- chat formatting ----------------------------------------------------------

def logged():
    """Snapshots of growing conversations, copies, forks and odd rows."""
    rnd = random.Random(3)
    rows, i = [], 0
    for _ in range(40):
        talk = [(rnd.choice(["user", "assistant", None]), f"turn {rnd.randrange(40)}" if rnd.random() < 0.9 else rnd.choice([None, ""]))
                for _ in range(rnd.randrange(1, 9))]
        start = rnd.choice([0, 1, 100])
        for n in {len(talk), *(rnd.randrange(1, len(talk) + 1) for _ in range(3))}:
            part = talk[:n] if rnd.random() < 0.8 else [*talk[:n - 1], ("user", "a fork")]
            rows += [(i, start + 2 * k, r, t) for k, (r, t) in enumerate(part)]
            i += 1
    rows += [(i, None, "user", "no turn"), (i, 1, "user", "then"), (None, 0, "user", "nobody"), (i + 1, 0, "system", "x" * 300_000)]
    rows += rows[:7]                                                             # repeated rows
    rows += [(i + 2, t, "user", f"long {t}") for t in range(3000)]
    rows += [(i + 3, t, "user", f"long {t}") for t in range(2999)]
    return rows


def brute_format(rows):
    talks = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or conversations.ROLE, text or ""))
    talks = {c: [x[2:] for x in sorted(t)] for c, t in talks.items()}
    out = {}
    for c, t in talks.items():
        if not any(o[:len(t)] == t and (len(o) > len(t) or d < c) for d, o in talks.items() if d != c):
            out[c] = (len(t), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t))
    return out


def joined(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.segment)):
        n, text = out.get(r.conv_id, (r.n_turns, ""))
        assert n == r.n_turns
        out[r.conv_id] = (n, text + r.text)
    return out


@pytest.mark.parametrize("chunk, segment", [(1024, 256), (2, 3)])
def test_format_equals_brute_force(table, monkeypatch, chunk, segment):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = logged()
    df = table(rows, "conv_id long, turn long, role string, text string").repartition(6)
    found = conversations.chat_format(df).collect()
    assert joined(found) == brute_format(rows)
    assert all(r.text.count("<|im_end|>") <= segment for r in found)


def test_no_conversations(table):
    df = table([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversations.chat_format(df.limit(0)).count() == 0
    assert conversations.chat_format(df.where("conv_id > 5")).count() == 0


# ---- token attribution ----------------------------------------------------------

def brute_counts(path, text, sections, rule):
    tokens = bpe.tokenizer(path)
    owner, at = [], 0
    at_char = [k for k, c in enumerate(text) for _ in c.encode()]
    held = {}
    for k, (a, b) in enumerate(sections):
        for c in range(max(a, 0), min(b, len(text))):
            held.setdefault(c, k)
    for i in tokens.encode_texts([text])[0]:
        size = int(tokens.token_length[i])
        chars = sorted(set(at_char[at:at + size]))
        at += size
        own = [held[c] for c in range(chars[0], chars[-1] + 1) if c in held]
        if not own:
            owner.append((-1, False))
        else:
            k = own[0] if rule == "start" else max(sorted(set(own)), key=own.count)
            owner.append((k, len(own) < chars[-1] + 1 - chars[0] or len(set(own)) > 1))
    assert at == len(at_char)
    return {k: (sum(o == k for o, _ in owner), sum(o == k and x for o, x in owner)) for k in {o for o, _ in owner} | set(range(len(sections)))}


TEXTS = ["hello world, 日本語 is été\n\n\nfoo  bar\n", "", None, "abc def ghijkl", "\n\n", "😀😀 ok\r\nx", "word " * 30_000, "no line feed"]


def test_lines_equal_brute_force(table, vocabulary):
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (None, "a\nb")]
    got = {}
    found = attribution.token_counts(table(rows, "doc_id long, text string").where("doc_id is not null"), vocabulary).collect()
    for r in found:
        got.setdefault(r.doc_id, {}).setdefault(r.section, []).append((r.start, r.end, r.n_tokens, r.n_crossing))
    for i, t in enumerate(TEXTS):
        spans = [m.span() for m in re.finditer(r"[^\n]*\n|[^\n]+", t or "")]
        want = brute_counts(vocabulary, t or "", spans, "overlap")
        assert -1 not in want
        times = 2 if i == 0 else 1
        assert got.get(i, {}) == {k: [(*spans[k], *want[k])] * times for k in want}
    assert attribution.token_counts(table(rows, "doc_id long, text string").limit(0), vocabulary).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_given_sections_equal_brute_force(table, vocabulary, rule):
    rnd = random.Random(9)
    rows, plain = [], {}
    for i in range(80):
        t = "".join(rnd.choice(["the", "quick ", "日本", " ", "token", "s", "é", "\n", "12", "ization"]) for _ in range(rnd.randrange(0, 25)))
        spans = [(rnd.randrange(-2, len(t) + 3), rnd.randrange(-2, len(t) + 5)) for _ in range(rnd.randrange(0, 5))]
        rows.append((i, t, [(f"f{k}", a, b) for k, (a, b) in enumerate(spans)]))
        plain[i] = (t, sorted(spans))
    rows += [(80, None, [("x", 0, 3)]), (81, "text", None), (82, "text", [None, ("y", None, 2), ("z", 1, 3)])]
    plain |= {80: ("", [(0, 3)]), 81: ("text", []), 82: ("text", [(1, 3)])}
    df = table(rows, "doc_id long, text string, fields array<struct<name:string,start:int,end:int>>")
    got = {}
    for r in attribution.token_counts(df, vocabulary, sections="fields", rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing)
    for i, (t, spans) in plain.items():
        assert got.get(i, {}) == brute_counts(vocabulary, t, spans, rule), (i, t, spans)


def test_unknown_rule(table, vocabulary):
    with pytest.raises(ValueError):
        attribution.token_counts(table([(1, "x")], "doc_id long, text string"), vocabulary, rule="half")
