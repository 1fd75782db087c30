"""Personal data: base spans by the plain forms, and what the patterns add."""

import random
import re

from docsift.llm import pii as P

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(n):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def base(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x[-4:]) > 255 or len(x.lstrip("0")) > 3 for x in m.group().split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d))
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def with_check(n):
    return next(n + str(c) for c in range(10) if luhn(n + str(c)))


random.seed(4)
CARD = with_check("448523961073215")
TEXTS = [None, "", " ", "a@b.c x@a.b_c@d.e %@x.y a..b@c-d.e.f. q@w..e u@v.w.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3 01.2.3.4x 1..2.3.4",
         f"{CARD} {CARD[:4]} {CARD[4:8]}-{CARD[8:12]} {CARD[12:]} {CARD}0 {CARD}  {CARD} 1 {CARD}x{CARD}", "+1 (017) 555-7713 +12345678901234567 +1-2 +49 30 1234567. +1 (2 + +1(555)1234567",
         "é漢🙂 me@x.org 漢 +1 (017) 555-7713 🙂" + CARD, "1 " * 30_000, "9" * 50_000, "a" * 50_000 + "@", "a.b" * 20_000 + "@c.d" + ".e" * 9_000, "+1" + " (" * 30_000 + "5",
         "1.1.1.1." * 5_000, "x@y." + "z." * 300 + "!", "\n".join(f"u{i}@h{i}.org 10.0.{i % 256}.7" for i in range(900))]
TEXTS += ["".join(random.choice("a1@.+-( )_%2 ") for _ in range(400)) for _ in range(60)]
TEXTS += ["".join(random.choice(["1", "23", " ", "-", ".", "+", "4 ", CARD, "@a.b"]) for _ in range(120)) for _ in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id bigint, text string, row string, spans int")


def test_base_spans_equal_the_plain_forms(spark):
    rows = list(enumerate(TEXTS)) + [(None, "me@x.org"), (5, TEXTS[5])]
    got = [(r.doc_id, [tuple(s) for s in r.base]) for r in P.extract(frame(spark, rows).repartition(4)).collect()]
    assert sorted(got, key=repr) == sorted(((d, base(t)) for d, t in rows), key=repr)


def test_patterns_find_what_the_forms_miss(spark):
    rows = [(i, f"noise {i} words. my card number {with_check(f'44852396107{i:04d}')} is mine") for i in range(12)]
    rows += [(100 + i, f"please write to user{i}@host{i}.org today") for i in range(12)]
    bad = next(c for c in ("4485239610732158", "4485239610732159") if not luhn(c))
    rows += [(200, f"again my card number {bad}, thanks"), (201, "please write to bob@intranet today"), (202, f"the score was {bad[:12]}0000 points"),
             (203, "version 2.0 of the code"), (204, f"a copy of {bad} elsewhere")]
    out = {r.doc_id: r for r in P.extract(frame(spark, rows)).collect()}
    text = dict(rows)

    def added(d):
        return [(P.KINDS[s.k], text[d][s.start:s.end]) for s in out[d].spans if s not in out[d].base]

    assert added(200) == [("card", bad)] and added(201) == [("email", "bob@intranet")] and added(204) == [("card", bad)]
    assert added(202) == [] and added(203) == [] and all(added(d) == [] for d in range(12))
    assert all(set(r.base) <= set(r.spans) for r in out.values())


def test_context_is_the_text_around_a_span_whatever_it_holds(spark):
    rows = [(i, f"{'é🙂 ' * (i * 40)}row 7 ip 10.0.0.{i} 200 ok") for i in range(12)]
    rows += [(100, "x " * 300 + "row 7 ip 10.0.0.256 200 ok")]
    out = {r.doc_id: r for r in P.extract(frame(spark, rows)).collect()}
    added = {d: [rows[-1][1][s.start:s.end] for s in r.spans if s not in r.base] for d, r in out.items()}
    assert added.pop(100) == ["10.0.0.256"] and not any(added.values())


def test_other_shapes_in_a_trusted_context(spark):
    bad = next(c for c in ("4485 2396 1073 2158", "4485 2396 1073 2159") if not luhn(c.replace(" ", "")))
    rows = [(i, f"note {i} please call me at +1 (017) 555-77{i:02d} today") for i in range(12)]
    rows += [(50 + i, f"my card number {with_check(f'44852396107{i:04d}')} is mine") for i in range(12)]
    found = {100: ("call me at (555) 123-4567, thanks", "phone", "(555) 123-4567"), 101: ("or call me at 555-123-4567.", "phone", "555-123-4567"),
             102: ("call me at 555 123  4567 today", "phone", "555 123  4567"), 103: (f"my card number {bad} is mine", "card", bad),
             104: ("call me at 0171 5551234 or 12 of 30", "phone", "0171 5551234"), 105: ("fax 555 123 4567 (office)", "phone", "555 123 4567"),
             106: (f"é🙂 card number {bad} 12 27", "card", bad)}
    rows += [(d, x[0]) for d, x in found.items()]
    rows += [(200, "call me at 5 today"), (201, "12 of 30 items 555 1234"), (202, "in 2024 5 of 123 4567 8 were new")]
    out = {r.doc_id: r for r in P.extract(frame(spark, rows)).collect()}
    added = {d: [(P.KINDS[s.k], dict(rows)[d][s.start:s.end]) for s in r.spans if s not in r.base] for d, r in out.items()}
    assert added == {d: [found[d][1:]] if d in found else [] for d, _ in rows}


def test_added_spans_never_overlap(spark):
    rows = [(i, f"call me at +1 (017) 555-77{i:02d} today") for i in range(12)] + [(100, "call me at 555 123 4567 200 300 400 500 600 call me at 123 4567 200 today" * 3)]
    r = next(r for r in P.extract(frame(spark, rows)).collect() if r.doc_id == 100)
    assert r.spans and all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:]))


def test_empty_table(spark):
    assert P.extract(frame(spark, []).limit(0)).count() == 0
