"""Altered licence texts that keep the coverage are found."""

import pytest

from tierlens.llm.license_scan import TEMPLATES, Index, scan_licenses

INDEX = Index(TEMPLATES)


def names(words):
    return {m[0] for m in INDEX.matches([0] * 7 + words + [0] * 3, 0.8)}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_one_word_changed_or_dropped_anywhere(name):
    t = INDEX.words[INDEX.names.index(name)]
    for at in range(len(t)):
        assert name in names(t[:at] + [0] + t[at + 1:]) and name in names(t[:at] + t[at + 1:])
        assert name in names(t[:at] + [0] + t[at:])  # or one put in


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_fifth_word_changed(name):
    t = INDEX.words[INDEX.names.index(name)]
    for first in range(5):
        words = [0 if i % 5 == first else w for i, w in enumerate(t)]
        if sum(map(bool, words)) >= 0.8 * len(t):
            assert name in names(words)


def test_altered_notices(spark):
    docs = spark.createDataFrame(
        [(1, "zzz Released under the MIT Licence zzz"), (2, "zzz Licensed under the Apache Licence, Version 2.0 zzz"),
         (3, "the the the the under the license"), (4, "Released under the MIT License. Released under the MIT License.")], "doc_id long, text string")
    got = sorted((r.id, r.license, round(r.coverage, 3), r.first_word) for r in scan_licenses(docs).collect())
    assert got == [(1, "MIT-notice", 0.8, 1), (2, "Apache-2.0-notice", 0.875, 1), (4, "MIT-notice", 1.0, 0), (4, "MIT-notice", 1.0, 5)]
