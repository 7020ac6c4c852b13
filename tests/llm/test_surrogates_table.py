"""Surrogates over a whole table against a detector in plain Python, written apart from the operator's patterns."""

import re

import pyarrow.parquet as pq

from rankwell.llm import pii

SF = "/root/testdata/sf0.01"


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def found(text):
    """(kind, start, end) of mails, addresses, social numbers, phones and cards, by walking over runs of characters."""
    out = []
    for m in re.finditer(r"\S+", text):
        run, at = m[0], m.start()
        if run.count("@") == 1:
            left, right = run.split("@")
            a = re.search(r"[\w%+-]+(\.[\w%+-]+)*$", left)
            b = re.match(r"([\w-]+\.)+[^\W\d_]{2,24}(?![\w-])", right)
            if a and b:
                out.append(("email", at + a.start(), at + len(left) + 1 + b.end()))
        core = run.strip(".,;:!?()\"'#$%&*|<>")
        start = at + run.index(core) if core else at
        octets = core.split(".")
        if len(octets) == 4 and all(o.isdigit() and o.isascii() and int(o) < 256 and str(int(o)) == o for o in octets):
            out.append(("ip", start, start + len(core)))
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", core):
            out.append(("ssn", start, start + len(core)))
        if core.isdigit() and core.isascii() and 13 <= len(core) <= 19 and luhn(core):
            out.append(("card", start, start + len(core)))
    for m in re.finditer(r"\+\d+ \(\d{3}\) \d{3}-\d{4}", text):
        out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: x[1])


def shape(text):
    return re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", text)))


def test_surrogates_over_the_table(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = {d["doc_id"]: d["text"] for d in docs}
    got = {r.doc_id: r for r in pii.replace_entities(spark.read.parquet(f"{SF}/documents.parquet"), "a key").collect()}
    assert set(got) == set(texts)
    new_of, old_of, seen = {}, {}, 0
    for doc, text in texts.items():
        if text is None:
            assert got[doc].text is None
            continue
        here = found(text)
        kinds = list(got[doc].kinds)
        for kind in ("email", "ip", "ssn", "card", "phone"):
            assert sum(k == kind for k in kinds) == sum(x[0] == kind for x in here), (doc, kind)
        if "name" in kinds or "secret" in kinds or "iban" in kinds:
            continue
        # without names, runs of non-blanks stay in place: only those that hold what was found change
        new, was = [(m[0], m.start()) for m in re.finditer(r"\S+", got[doc].text)], [(m[0], m.start()) for m in re.finditer(r"\S+", text)]
        assert len(new) == len(was)
        inside = set()
        for kind, a, b in here:
            at = [i for i, (run, start) in enumerate(was) if start < b and start + len(run) > a]
            shift = a - was[at[0]][1]
            old, run = text[a:b], got[doc].text[new[at[0]][1] : new[at[-1]][1] + len(new[at[-1]][0])]
            repl = re.search(r"\d+\.\d+\.\d+\.\d+", run)[0] if kind == "ip" else run[shift : shift + b - a]
            digits = kind in ("card", "phone", "ssn")
            one, two = (re.sub(r"\D", "", x) if digits else x.lower() for x in (old, repl))
            assert one != two and (kind == "ip" or shape(old) == shape(repl)), (old, repl)
            assert new_of.setdefault((kind, one), two) == two and old_of.setdefault((kind, two), one) == one, (kind, old)
            assert kind != "card" or luhn(two)
            inside.update(at)
            seen += 1
        assert {i for i, (x, y) in enumerate(zip(was, new, strict=True)) if x[0] != y[0]} <= inside, doc
    assert seen > 20
    originals = {k for k in new_of}
    assert not originals & set(old_of)  # no replacement is itself somebody's
