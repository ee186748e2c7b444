"""Personal data: fixed patterns against Python's plain ones, the bootstrapped ones against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import regex

from parchmill.llm import pii
from parchmill.llm.pii import find, joined
from parchmill.llm.queries import op12_contextual_pii
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, base string, words int, row long, kind string, t string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLAIN["card"] = r"[0-9]([ -]?[0-9])+"  # the class holds a space and a hyphen


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def ok(kind, t, phone=(10, 15)):
    digits = re.sub("[^0-9]", "", t)
    if kind == "ip":
        return all(int(x) <= 255 for x in t.split("."))
    return kind == "email" or (14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else phone[0] <= len(digits) <= phone[1])


def base_of(text):
    text = text or ""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text) if ok(kind, m[0]))


def windows_of(text):
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text, re.ASCII) if re.search("[0-9@]", m[0])]
    edges = [0, *[x for w in words for x in w], len(text)]
    for i in range(len(words)):
        for n in range(pii.WORDS):
            j = i + n
            if j >= len(words) or any(text[words[q][1] : words[q + 1][0]] != " " for q in range(i, j)) or words[j][1] - words[i][0] > pii.LONGEST:
                break
            s, e = words[i][0], words[j][1]
            before, after = text[edges[2 * i] : s][-pii.CONTEXT :], text[e : edges[2 * j + 3]][: pii.CONTEXT]
            while s < e and not re.match("[0-9A-Za-z+(]", text[s]):
                s += 1
            while e > s and not re.match("[0-9A-Za-z)]", text[e - 1]):
                e -= 1
            forms = [regex.search(pii._FORMS[k], text[s:e], regex.ASCII) for k in pii.KINDS]
            if forms[0] or forms[1] or (forms[3] and len(re.sub("[^0-9]", "", text[s:e])) >= 7):
                yield s, e, text[s:e], before, after


def brute(docs):
    """[(doc_id, base, added)] of all rows."""
    seen, edges = [], defaultdict(dict)
    for doc, text in docs:
        text = text or ""
        base, own = base_of(text), []
        for s, e, t, before, after in windows_of(text):
            same = [k for a, k, b in base if (a, b) == (s, e)]
            if any(a < e and s < b and (a, b) != (s, e) for a, k, b in base):
                continue
            shape = regex.sub(r"\p{L}+", "a", re.sub("[0-9]", "9", t))
            left, right = regex.search(r"(\p{L}{1,30})[^\p{L}0-9@]*\z", before), regex.match(r"[^\p{L}0-9@]*(\p{L}{1,30})", after)
            left, right = left[1].lower() if left else "", right[1].lower() if right else ""
            patterns = {f"s|{shape}", f"l|{shape}|{left}", f"r|{shape}|{right}", f"c|{left}|{right}|{re.sub('9+', '9', shape)}"}
            kind = min(same) if same else None
            for p in patterns:
                edges[p][t] = max([x for x in (edges[p].get(t), kind) if x is not None], default=None)
            own.append((s, e, t, kind, patterns))
        seen.append((doc, base, own))
    seeds = {}
    for ts in edges.values():
        for t, kind in ts.items():
            if kind is not None:
                seeds[t] = max(kind, seeds.get(t, kind))
    conf, good = {t: (1.0, k) for t, k in seeds.items()}, {}
    for _ in range(pii.ROUNDS):
        good = {}
        for p, ts in edges.items():
            if not any(k is not None for k in ts.values()):
                continue
            options = []
            for k in range(4):
                options.append((sum(conf[t][0] for t in ts if t in conf and conf[t][1] == k), -k, sum(seeds.get(t) == k for t in ts)))
            total, k, support = max(options)
            if support >= pii.SUPPORT and total / (len(ts) + 1) >= pii.PASSED_ON:
                good[p] = (total / (len(ts) + 1), -k)
        conf = {t: (1.0, k) for t, k in seeds.items()}
        for p, (c, k) in good.items():
            for t in edges[p]:
                if t not in seeds:
                    conf[t] = max(conf.get(t, (0, -9)), (c, k), key=lambda x: (x[0], -x[1]))
    out = []
    for doc, base, own in seen:
        hits = {}
        for s, e, t, kind, patterns in own:
            for p in patterns if kind is None else ():
                c, k = good.get(p, (0, None))
                if c >= pii.CONFIDENCE and regex.search(pii._FORMS[pii.KINDS[k]], t, regex.ASCII) and ok(pii.KINDS[k], t, (7, 15)):
                    hits[s, e] = max(hits.get((s, e), (0, -9)), (c, -k))
        added = []
        for (s, e), (_, k) in sorted(hits.items(), key=lambda x: (x[0][0], -x[0][1])):
            if not added or s >= added[-1][2]:
                added.append((s, -k, e))
        out.append((doc, base, added))
    return out


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def frame(spark, docs):
    return spark.createDataFrame([(*d, "b", 1, 2, "k", "t") for d in docs], DOCS).repartition(3)


ODD = [
    None, "", " ", "a@b", "a@b.c", "a@b.c_d@e.f", "x.@y..z", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.255 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111", "5 -4111111111111111",
    "5--4111111111111111", "+1 (23) 456-78901", "+12345678901234567", "+1 2", "é😀 a@b.de +49 30 1234567 ", "mail:é_x@y.z,1.1.1.1", "1" * 14, "0" * 19, "0" * 20, "+1 (269) 555-3296 4524132264652876", "%%a@b.c%%", "x@y.z\n1.2.3.4\t+1(2)34567890",
]


def planted(seed):
    """Texts with identifiers among words; some stand where no fixed pattern can find them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 4)))
    phone = lambda: f"+1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"

    def card():
        body = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if luhn(body + c))

    docs = []
    for i in range(60):
        things = [phone(), card(), f"{word()}.{i}@mail{i % 3}.org", f"10.{i}.7.{i * 3 % 256}", str(r.randint(1900, 2030)), f"tel {r.randint(200, 999)}-{r.randint(1000, 9999)}"]
        if i % 9 == 0:
            things = [f"{phone()} {card()}", *things]
        docs.append((i, " ".join(f"{word()} {x}{r.choice(['', ',', '.'])} {word()}" for x in things)))
    return docs


def test_query_against_brute_force(spark, tmp_path):
    docs = planted(1) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, ODD[-3]), (5, "again 10.0.0.1"), (5, "again 10.0.0.1")]
    want = sorted(((doc, text_of(base), text_of([*base, *added]), len(added)) for doc, base, added in brute(docs)), key=str)
    assert sum(w[3] for w in want) >= 10
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op12_contextual_pii(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["base_sha256"], r["spans"], r["n_added"]) for r in rows), key=str) == sorted(((d, hashlib.sha256(b.encode()).hexdigest(), a, n) for d, b, a, n in want), key=str)
    counts = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows), key=str)
    assert counts == sorted(((d, *[sum(k == i for _, k, _ in base) for i in range(4)]) for d, base, _ in brute(docs)), key=str)


def test_fixed_patterns_on_random_texts(spark):
    r = random.Random(2)
    docs = [(i, "".join(r.choice("0011 -.@+()a_%é\n12") for _ in range(r.randint(0, 120)))) for i in range(1500)]
    docs += [(5000 + i, "".join(r.choice(["4111111111111111", "1.2.3", ".4", " ", "-", "a@b", ".c", "+1 ", "(555) ", "0123456789", "x"]) for _ in range(r.randint(0, 12)))) for i in range(1500)]
    got = {x["doc_id"]: x["base"] for x in find(frame(spark, docs)).select("doc_id", joined(F.col("base")).alias("base")).collect()}
    assert got == {d: text_of(base_of(t)) for d, t in docs}


def test_long_and_empty(spark):
    """Long runs take neither quadratic time nor stack; an empty table stays empty."""
    docs = [(1, "7" * 300_000), (2, "1 " * 100_000), (3, "a" * 300_000 + " b@c.de"), (4, "1." * 50_000), (5, "w " * 200_000 + "b@c.de"), (6, "+1" + " 2" * 50_000)]
    began = time.time()
    got = {x["doc_id"]: x["base"] for x in find(frame(spark, docs)).select("doc_id", joined(F.col("base")).alias("base")).collect()}
    assert got == {1: "", 2: "", 3: "email:300001:300007", 4: ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(12_500)), 5: "email:400000:400006", 6: ""} and time.time() - began < 120
    assert find(frame(spark, [])).count() == 0
