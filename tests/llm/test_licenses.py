"""License scans against a plain scan; suppression; the gate."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import licenses as L
from tessera.llm.common import ascii_words
from tessera.llm.queries import op1_license_scan

RULES = L.build_rules()
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    return len(own), sorted(found)


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 300 and len({r.name for r in RULES}) == len(RULES)
    assert [r.priority for r in RULES] == sorted((r.priority for r in RULES), reverse=True)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("the mit license apache general public gnu gpl version 2 0 cc by nc sa 4 spdx identifier bsd 3 clause under licensed copyright 2020 all rights reserved unlicense x é".split()), max_size=25))
def test_gate_loses_nothing(words):
    said = " ".join(words).encode().split()
    assert L.detect(said, RULES) == L.detect(said, RULES, gate=False)


def by_hand(found):
    """Suppression by comparing every match with every one kept before."""
    order = sorted(range(len(found)), key=lambda i: (-found[i][2].priority, found[i][0] - found[i][1], found[i][0], RULES.index(found[i][2])))
    kept, out = [], set()
    for i in order:
        a, b, rule, _ = found[i]
        if not any(x <= a and b <= y and (rule.label == "copyright" or other != "copyright") for x, y, other in kept):
            kept.append((a, b, rule.label))
            out.add(i)
    return [i in out for i in range(len(found))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("the mit license apache general public gnu gpl lesser version 2 0 cc by nc sa 4 spdx identifier bsd 3 clause under licensed copyright 2020 2021 all rights reserved isc".split()), max_size=60))
def test_suppression_by_brute_force(words):
    found = L.detect(" ".join(words).encode().split(), RULES)
    assert [k for *_, k in found] == by_hand(found)
    for a, b, rule, _ in found:
        assert rule.regex.fullmatch(" ".join(words[a : b + 1]).encode())


def test_time_grows_with_the_matches():
    import time

    def seconds(n):
        said = ("licensed under the mit license version 2 copyright 2020 x " * n).encode().split()
        began = time.process_time()
        L.detect(said, RULES)
        return time.process_time() - began

    small, large = min(seconds(1500) for _ in range(2)), min(seconds(6000) for _ in range(2))
    assert large < 4 * 2.5 * max(small, 0.01), (small, large)


def test_every_rule_passes_the_gate():
    for names in L.NAMES.values():
        for name in names:
            said = ascii_words(name.replace(" V", " 4 0").replace("?", ""))
            assert L.detect(said, RULES), name
    for tag in ("MIT", "Apache-2.0", "GPL-3.0-or-later", "0BSD"):
        assert any(r.name.startswith("tag:") for _, _, r, kept in L.detect(ascii_words(f"SPDX-License-Identifier: {tag}"), RULES) if kept)


def test_short_forms():
    for said, label in (
        ("GPLv3", "gpl"), ("GPL-2.0+", "gpl"), ("gpl v2 or later", "gpl"), ("Licensed under MIT.", "mit"), ("Apache-2.0", "apache"), ("the LGPL-2.1 library", "lgpl"), ("AGPLv3 server", "agpl"),
        ("dual licensed under the Apache 2 or MIT", "apache"), ("MPL-2.0", "mpl"), ("EPL v2.0", "epl"), ("released under the BSD", "bsd"), ("MIT licensed", "mit"), ("CDDL-1.0", "cddl"), ("WTFPL", "wtfpl"), ("EUPLv1.2", "eupl"),
    ):
        assert {r.label for _, _, r, k in L.detect(ascii_words(said), RULES) if k} == {label}, said
    for said in ("he studied at MIT under great teachers", "the apache tribe", "apache helicopters 2", "gplex", "an epl match", "mpl"):
        assert not L.detect(ascii_words(said), RULES), said


def test_suppression():
    found = L.detect(ascii_words("This is licensed under the GNU Lesser General Public License, version 3."), RULES)
    kept = {r.label for _, _, r, k in found if k}
    assert kept == {"lgpl"} and any(r.label == "gpl" and not k for _, _, r, k in found)


def test_licenses_after_a_copyright_notice():
    for said, label in (("Copyright 2019 Acme. ISC License", "isc"), ("Copyright (c) 2020 Foo BSD License", "bsd"), ("Copyright 2021 MIT License", "mit"), ("Copyright 2021 2022 by Foo, zlib license", "zlib"), ("Copyright 2020. All rights reserved", "proprietary")):
        assert {r.label for _, _, r, k in L.detect(ascii_words(said), RULES) if k} == {"copyright", label}, said
    twice = [k for _, _, r, k in L.detect(ascii_words("(c) Copyright 2019 Acme"), RULES) if r.label == "copyright"]
    assert len(twice) == 2


def test_query_and_edge_rows(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "MIT License mit LICENSE."), (3, "MIT License mit LICENSE."), (4, "Apache\nLicense; GNU General-Public_License"), (5, "x " * 40000 + "mit license"), (None, "no license")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    docs.createOrReplaceTempView("edge")
    assert L.license_scan(docs).count() == len(rows) and L.license_scan(docs.where("false")).count() == 0
    got = {r["doc_id"]: r for r in op1_license_scan(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, found = plain(r["text"])
        mine = got[r["doc_id"]]
        want = (n, len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})))
        assert (mine["n_words"], mine["n_base"], mine["first_word"], mine["last_word"], mine["base_labels"]) == want
        assert set(filter(None, want[4].split(","))) <= set(mine["labels"].split(",")) and 0 <= mine["score"] <= 1
    for r in L.license_scan(docs).collect():
        if r["doc_id"] is not None:
            assert sorted((x["first"], x["label"]) for x in r["detections"] if x["base"]) == plain(dict(rows)[r["doc_id"]])[1]
