from __future__ import annotations

import hashlib
import random
import re

import pytest

from panelspark.llm.pii import KINDS, _bit, _context, _follower, _pairs, _settled, _Taken, base_spans, find_pii, learn_patterns, luhn, mask_pii, pii_report

from .rows import ODD, documents, frame

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def noise(seed, n=400):
    rng = random.Random(seed)
    return "".join(rng.choice(["1", "2", "22", "255", "256", "0", ".", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "é", "4111111111111111", "x\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_base_spans_are_those_of_the_plain_patterns(seed):
    assert base_spans(noise(seed)) == plain(noise(seed))


def test_base_spans_of_odd_texts():
    for t in ODD:
        assert base_spans(t or "") == plain(t or "")


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_report(spark):
    rows = documents(20) + [(7000 + i, noise(i), "en", "s") for i in range(20)]
    for r in pii_report(frame(spark, rows)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        spans = plain(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.spans == listed and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in FORMS]


def contexts():
    """Numbers after "call me" are phone numbers, also in a form the seeds don't have; "room number" is no such context."""
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(i, f"word Call me: +1 555 {digits(3)} {digits(4)} or come. room number {digits(6)} here", "en", "s") for i in range(30)]
    return rows + [(100, "please call me (0555) 123-4567 today", "en", "s"), (101, "please phone us 0555 123 4567 today", "en", "s"), (102, None, "en", "s")]


def test_contexts_find_unseen_forms(spark):
    rows = contexts()
    docs = frame(spark, rows)
    assert learn_patterns(docs) == [("phone", "call me")]
    found = {r.doc_id: [(s.kind, rows[-3][1][s.start:s.end] if r.doc_id == 100 else None, s.base) for s in r.spans] for r in find_pii(docs).collect() if r.doc_id >= 100}
    assert found == {100: [("phone", "(0555) 123-4567", False)], 101: [], 102: []}
    masked = {r.doc_id: r.text for r in mask_pii(docs).collect()}
    assert masked[100] == "please call me [PHONE] today" and masked[101] == rows[-2][1] and masked[102] is None
    assert masked[0].startswith("word Call me: [PHONE] or come.")


def test_seeds_spread_over_many_contexts(spark):
    """300 contexts of four seeds each: every one is a pattern, and the unseen forms behind them are found and masked."""
    word = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(3))
    rows = [(10 * i + k, f"so call {word(i)}: +1 555 {i:03} {k:04} or come", "en", "s") for i in range(300) for k in range(4)]
    rows += [(10 * i + 9, f"so call {word(i)}: (0555) 123-4567 or come, room xx 123456", "en", "s") for i in range(300)]
    docs = frame(spark, rows)
    assert sorted(learn_patterns(docs)) == sorted(("phone", f"call {word(i)}") for i in range(300))
    assert all([(s.kind, s.base) for s in r.spans] == [("phone", r.doc_id % 10 != 9)] for r in find_pii(docs).collect())
    assert all("call" in r.text and r.text.split(": ")[1].startswith("[PHONE] or come") for r in mask_pii(docs).collect())


@pytest.mark.parametrize("between", [". ", ", ", " - ", "; ", " [", ": ", " ", "\u201d ", " \u2014 ", "\u00a0"])
@pytest.mark.parametrize("words", ["call me", "appelle \u00c9lise", "\u03a3\u039f\u03a3 \u039f\u0394\u039f\u03a3"])
def test_what_induction_sees_the_finder_sees(words, between):
    for kind, seed, other in (("phone", "+1 555 010 9999", "(0555) 123-4567"), ("email", "a.b@c.de", "someone@localhost")):
        text = f"then \u201c{words}{between}{seed} or"
        end = text.index(words) + len(words)
        base = {(k, a): b for k, a, b in base_spans(text)}
        assert _context(text, end + len(between)) == words and _follower(kind, text, end, base) == (end + len(between), text.index(" or"), True)
        unseen = f"then {words.upper()}{between}{other} or"
        at = unseen.index(words.upper()) + len(words)
        assert _context(unseen, at).lower() == words.lower() and _follower(kind, unseen, at, {}) == (at + len(between), unseen.index(" or"), False)
        bits = [set(_bit(p, k).tolist()) for k in KINDS for p in (_pairs([words])[2],)]
        row, ends, pairs = _pairs(["x", text, unseen])
        hit = {(r, e) for r, e, bit in zip(row.tolist(), ends.tolist(), _bit(pairs, kind).tolist()) if bit in bits[KINDS.index(kind)]}
        assert hit == {(1, end), (2, at)}


CONTEXT = re.compile(r"([^\W\d_]+)[^\S\n]+([^\W\d_]+)[^\w\n]{0,3}\Z")


def test_contexts_are_those_of_the_plain_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aB\u00e9\u4e00 \t\n\u00a0.,-_5\u00b2\u0301(") for _ in range(rng.randint(0, 14)))
        found = CONTEXT.search(text)
        assert _context(text, len(text)) == (f"{found[1]} {found[2]}" if found else None), text
        ends = {e for e in range(1, len(text) + 1) if (e == len(text) or not re.match(r"[^\W\d_]", text[e])) and re.search(r"[^\W\d_]+[^\S\n]+[^\W\d_]+\Z", text[:e])}
        assert set(_pairs(["", text, "b"])[1][_pairs(["", text, "b"])[0] == 1].tolist()) == ends, text


def test_separators_between_context_and_identifier(spark):
    """Seeds behind a dash or a full stop are followers like all others, and unseen forms there are found."""
    for k, between in enumerate((" - ", ". ")):
        rows = [(i, f"so call me{between}+1 555 {i:03} 0000 or", "en", "s") for i in range(9)] + [(9, f"so call me{between}(0555) 123-4567 or", "en", "s")]
        docs = frame(spark, rows)
        assert learn_patterns(docs) == [("phone", "call me")]
        assert {r.doc_id: r.text for r in mask_pii(docs).collect()}[9] == f"so call me{between}[PHONE] or"


def test_mask_keeps_columns(spark):
    rows = [(1, "a@b.cd x", 8, 1.5, "r"), (1, "a@b.cd x", 8, 1.5, "r"), (None, "", 0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, masked double, row string")
    got = mask_pii(df)
    assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "[EMAIL] x", 9, 1.5, "r")] * 2 + [(None, "", 0, None, None)]))
    assert pii_report(frame(spark, [], partitions=1)).collect() == []


def test_added_spans_overlap_no_other():
    """Against comparing every candidate with every span."""
    rng = random.Random(8)
    for _ in range(400):
        stretch = lambda: (a := rng.randrange(60), a + rng.randint(1, 9))
        base = [(rng.choice(KINDS), *stretch()) for _ in range(rng.randint(0, 5))]
        more = [{"kind": rng.choice(KINDS), "pattern": rng.choice("ab"), "start": a, "end": b, "confidence": rng.choice((0.6, 0.9))}
                for a, b in (stretch() for _ in range(rng.randint(0, 12)))]
        apart = lambda a, b, spans: all(b <= c or d <= a for c, d in spans)
        taken = _Taken(base)
        for a, b in (stretch() for _ in range(10)):
            assert taken.free(a, b) == apart(a, b, [s[1:] for s in base])
        own = [s[1:] for s in base]
        for m in sorted(more, key=lambda m: (-m["confidence"], m["kind"], m["pattern"], m["start"])):
            if apart(m["start"], m["end"], own):
                own.append((m["start"], m["end"]))
        assert sorted(s[1:3] for s in _settled(base, more)) == sorted(own)


def test_one_long_text_full_of_contexts(spark):
    """Tens of thousands of seeds and unseen forms behind one context in one text: every one is found."""
    seeds = " ".join(f"so call me: +1 555 {i:07} or" for i in range(24_000))
    unseen = " ".join(f"so call me: (0555) {i:07} or" for i in range(6_000))
    found = {r.doc_id: (len(r.spans), sum(s.base for s in r.spans)) for r in find_pii(frame(spark, [(1, seeds + " " + unseen, "en", "s"), (2, None, "en", "s")])).collect()}
    assert found == {1: (30_000, 24_000), 2: (0, 0)}
