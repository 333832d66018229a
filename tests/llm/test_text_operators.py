"""PII, quality, token counts, codec and licenses against brute force."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from lexmill.llm import bpe, codec, licenses, pii, quality, token_counts

ODD = [None, "", " ", "\n\n", "a", "A a A a", "0" * 3000, "a." * 2000 + "@", "1 " * 3000, "x " * 4000, "é👍" * 500, "same line\nsame line\n\nsame line", "tab\tsep\x0bvt\x0cff\rcr"]
CLASH = "pii string, n_words long, ids string, slot string, hub string, kept boolean"


def _random_texts(seed, alphabets, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def _luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def _base_spans(text):
    text, out = text or "", []
    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_spans_match_brute_force(docs):
    texts = [*ODD[:6], *ODD[7:], *_random_texts(1, ["a1@.+-_% 0234()\n5678é👍", "0123456789 -.", "a.@b_"], 600, 60), "a@b.cd_x@y.zz a@b.c.d@e.f 4111-1111-1111-1111 +1 (555) 010-9999 10.0.0.256 010.1.2.3"]
    got = {r.doc_id: r for r in pii.digest(docs(texts)).collect()}
    for i, text in enumerate(texts):
        spans = _base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        counts = [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone, got[i].base_sha256] == [*counts, hashlib.sha256(joined.encode()).hexdigest()], text


def test_pii_adds_checked_kinds_and_redacts(spark, docs):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00", "SSN 123-45-6789", "part 123-45-6789", 'token = "24be64439e3e49cf46b2d7c90f3602a3"', None, "👍 mail a@b.cd now"]
    got = {r.doc_id: r.spans for r in pii.digest(docs(texts)).collect()}
    assert got[0].startswith("iban:5:") and "iban" not in got[1] and got[2] == "ssn:4:15" and got[3] == "" and got[4].startswith("secret:0:")
    clean = {r.doc_id: r.text for r in pii.redact(docs(texts)).collect()}
    assert clean[6] == "👍 mail [EMAIL] now" and clean[5] is None and clean[0] == "IBAN [IBAN] ok"
    wide = docs(texts).select("*", F.lit("x").alias("pii"), F.lit(1).alias("n_email"))
    assert pii.redact(wide).columns == wide.columns and pii.digest(wide).count() == len(texts)


def test_pii_context_reaches_over_earlier_spans(docs):
    numbers = ["123-45-6789", "234-56-7890", "345-67-8901", "456-78-9012", "567-89-0123"]
    texts = ["SSN: 123-45-6789, 234-56-7890", "SSN: " + ", ".join(numbers[:-1]) + " and " + numbers[-1], "SSN 123-45-6789 and then " + "x" * 40 + " 234-56-7890", "parts 123-45-6789, 234-56-7890", "SSN 123-45-6789 or part 234-56-7890", "123-45-6789, ssn 234-56-7890"]
    got = {r.doc_id: r.spans for r in pii.digest(docs(texts)).collect()}
    assert got[0] == "ssn:5:16,ssn:18:29" and got[1].count("ssn") == 5 and got[2] == "ssn:4:15" and got[3] == ""
    assert got[4] == "ssn:4:15,ssn:24:35" and got[5] == "ssn:17:28"
    clean = {r.doc_id: r.text for r in pii.redact(docs(texts)).collect()}
    assert clean[0] == "SSN: [SSN], [SSN]" and not any(n in clean[1] for n in numbers)


def _quality_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_match_brute_force(docs):
    texts = [t for t in ODD if len(t or "") < 500] + _random_texts(2, ["ab \n", "#$x é\n", "a "], 300, 120) + ["w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3]
    got = {r.doc_id: r for r in quality.quality(docs(texts)).collect()}
    for i, text in enumerate(texts):
        row, want = got[i], _quality_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, text
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def test_quality_distance_rejects_other_distributions(spark):
    rng = random.Random(3)
    common = "the of and to in a is that for it".split()
    good = [" ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(["house", "garden", "letter", "winter", "morning"]) + str(k % 7)[:0] + "abcdefgh"[k % 8] for k in range(150)) + "." for _ in range(60)]
    junk = ["|".join("ABCDEF"[k % 6] * 5 for k in range(i, i + 150)).replace("|", " | ") + "!" * i for i in range(3)]
    rows = [(i, t, "en") for i, t in enumerate(good + junk)] + [(99, "word " * 0, None)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[60 + i] for i in range(3)) and got[99] is False


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_equals_the_library(name):
    path = public_tokenizers.path(name)
    library, own = Library.from_file(path), bpe.tokenizer_of(path)
    alphabet = "abcdefghijklmnop ABC  \n\t'.,;!?-0123éüß中文👍🏽ΣσςİıŒ\xa0 　<|>_"
    texts = [t or "" for t in ODD] + _random_texts(4, [alphabet, "aab", "=-'", "$& "], 800, 120) + ["a<|endoftext|>b <|startoftext|>", "don't I'Ll we'RE", "$$$ &&& ###", "aaaaaaaaa", " " * 300]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(text) == want.ids, text


def test_prefix_counts_equal_encoding_every_prefix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Library.from_file(path), bpe.tokenizer_of(path)
    for text in [*_random_texts(5, ["ab  \n\t'.,0é👍<|>strevdlm"], 150, 40), "hi <|endoftext|> yo", "it's'd  we'll\n\n ok"]:
        counts = token_counts.PrefixCounts(own, text)
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counts.counts == want, text
        for limit in range(want[-1] + 1):
            assert counts.fits(limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_token_count_query(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Library.from_file(path)
    texts = [*ODD, "word " * 700, "a <|endoftext|> b " * 300]
    got = {r.doc_id: r for r in token_counts.token_counts(docs(texts), path, 512).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512)
        head = len(library.encode((text or "")[: got[i].fit_chars], add_special_tokens=False).ids)
        assert head <= 512 and (n > 512 or got[i].fit_chars == len(text or ""))


def test_codec_round_trip(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Library.from_file(path)
    texts = [*ODD, "Déjà VU <|endoftext|> isn't"]
    for row in codec.encode(docs(texts), path, full=True).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded == library.decode(ids, skip_special_tokens=False) == codec.decode(bpe.tokenizer_of(path), ids)


def _license_base(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_matches_brute_force(docs):
    rng = random.Random(6)
    parts = ["MIT", " ", "License", "license", "CC", "BY", "\n", "-", ".", "é", "gnu", "GNU", "general", "public ", "Apache", " ", "2.0", "K"]
    texts = [*ODD[:6], *ODD[9:], *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)), "MIT License. " * 200]
    got = {r.doc_id: r for r in licenses.digest(docs(texts)).collect()}
    for i, text in enumerate(texts):
        row = got[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == _license_base(text), text
        assert 0 <= row.score <= 1 and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))


def test_license_rules_order_and_suppression(docs):
    got = {r.doc_id: r.labels for r in licenses.digest(docs(["Licensed under the Apache License, Version 2.0.", "BSD 3-Clause license", "mit dem Haus", "CC BY-NC-SA 4.0", "GPL v2 or later, LGPL 2.1"])).collect()}
    assert got == {0: "apache,apache-2.0", 1: "bsd-3-clause", 2: "", 3: "cc-by,cc-by-nc-sa-4.0", 4: "gpl-2.0,lgpl-2.1"}
    assert len(licenses.RULES) > 200


def test_license_gates_pass_wrapped_names(docs):
    cases = {
        "GNU Lesser\nGeneral Public License": "lgpl",
        "the GNU General\nPublic License, version 3": "gpl-3.0",
        "All rights\nreserved": "proprietary",
        "SIL Open  Font\nLicense 1.1": "ofl-1.1",
        "European\nUnion Public Licence 1.2": "eupl-1.2",
        "released into the public\ndomain": "public-domain",
        "GNU Free\nDocumentation License": "gfdl",
        "Common\nDevelopment and Distribution License": "cddl",
        "Common\tPublic License": "cpl",
        "Open\nSoftware License": "osl",
        "Microsoft\nPublic License": "ms-pl",
        "Open\nDatabase License": "odbl",
    }
    got = {r.doc_id: r.labels.split(",") for r in licenses.digest(docs(list(cases))).collect()}
    for i, (text, label) in enumerate(cases.items()):
        assert label in got[i], text


def test_license_short_forms_identifiers_and_wordings(docs):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
    gpl = "under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or"
    cases = {
        "GPLv3": "gpl-3.0", "GPL3": "gpl-3.0", "GPLv2+": "gpl-2.0", "GPL-2.0-or-later": "gpl-2.0", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3.0", "MPLv2": "mpl-2.0", "WTFPLv2": "wtfpl-2", "Apache2": "apache-2.0",
        "GPL version 2": "gpl-2.0", "GPL v. 2": "gpl-2.0",
        "SPDX-License-Identifier: MIT": "mit", "# SPDX-License-Identifier: ISC": "isc", "SPDX-License-Identifier: (MIT OR EPL-2.0)": "epl-2.0,mit", "SPDX-License-Identifier: 0BSD": "bsd-0-clause",
        "Permission is hereby granted, free of charge": "mit", "Permission is hereby granted, free\n * of charge, to any person obtaining": "mit",
        "Permission is hereby granted, free of charge, to any person or organization": "bsl",
        bsd: "bsd", gpl: "gpl-3.0",
        "Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products": "bsd-3-clause",
        "mit ISC zlib cc01 epl GPLx": "",
    }
    got = {r.doc_id: r.labels for r in licenses.digest(docs(list(cases))).collect()}
    for i, (text, labels) in enumerate(cases.items()):
        assert set(filter(None, labels.split(","))) == set(filter(None, got[i].split(","))) - ({"gpl"} if text == gpl else set()), (text, got[i])


def test_empty_tables(spark, docs):
    none = docs([])
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (pii.digest(none), pii.redact(none), quality.quality(none), quality.keep_good(none), token_counts.token_counts(none, path), codec.encode(none, path), licenses.digest(none)):
        assert out.count() == 0


def test_quality_knows_languages_from_their_own_texts(spark):
    rng = random.Random(8)
    common, letters = "از به در که را با این آن برای است".split(), "ابپتجدرسشکلمنوهی"
    persian = [" ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(5)) for _ in range(80)) for _ in range(400)]
    stray = " ".join(rng.choice("the of and to in a is that house garden letter".split()) for _ in range(1100))
    rows = [(i, t, "fa") for i, t in enumerate(persian)] + [(1000, stray, "fa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"kept": F.lit("x"), "n_words": F.lit(0)})
    got = {r.doc_id: r.kept for r in quality.quality(frame).collect()}
    assert all(got[i] for i in range(400)) and got[1000] is False
    left = quality.keep_good(frame)
    assert left.columns == frame.columns and left.count() == 400


def test_prefix_table_answers_every_budget(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, "word " * 700, "a <|endoftext|> b", "x\n\n\ny  z"]
    frame = docs(texts).withColumns({"steps": F.lit(1), "n_tokens": F.lit("x")})
    table = token_counts.prefix_table(frame, path).cache()
    for limit in (0, 3, 512):
        assert sorted(map(tuple, token_counts.budget(table, limit).collect())) == sorted(map(tuple, token_counts.token_counts(frame, path, limit).collect()))


def test_many_matches_in_one_text(spark):
    rows = [(1, "write a@b.cd now " * 40_000), (2, "MIT License, Apache License 2.0 " * 20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(frame).collect()}
    assert found[1].n_email == 40_000 and pii.redact(frame).where("doc_id = 1").first().text == "write [EMAIL] now " * 40_000
    assert {r.doc_id: r.n_base for r in licenses.digest(frame).collect()} == {1: 0, 2: 40_000}


def test_clashing_columns_are_not_read(docs):
    path, words = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    plain = docs(["some words here", None])
    wide = plain.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")})
    for run in (pii.digest, quality.quality, licenses.digest, lambda d: token_counts.token_counts(d, path), lambda d: codec.encode(d, words)):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(plain).collect()))
