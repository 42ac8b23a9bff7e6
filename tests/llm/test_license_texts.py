"""Licenses against a scan of every window: bodies and notices that no test document plants, versions told apart, long texts."""

import random
import re

import numpy as np
import pytest

from veridan.llm import license_scan

from test_operators import license_of  # pytest puts this folder on the path

WORDS = [f"w{i}" for i in range(400)]
GROUPS = license_scan.grouped(license_scan.TEMPLATES)


def _noise(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _bare(template):
    return re.sub("[{}]", "", template)


def _licenses(text):
    return {x[1] for x in license_scan.found([text], GROUPS) if x[4]}


@pytest.mark.parametrize(("name", "template"), [(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts])
def test_every_template_is_found_as_its_own_license(name, template):
    rng = random.Random(3)
    # What one license says word for word inside another one's text is the longer text's.
    longer = {n for n, ts in license_scan.TEMPLATES.items() for t in ts if _bare(template).rstrip(".") in _bare(t)}
    assert _licenses(f"{_noise(rng, 90)} {_bare(template)} {_noise(rng, 70)}") & (longer | {name})
    assert not _licenses(_noise(rng, 900))


@pytest.mark.parametrize(("text", "want"), [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
    (license_scan._BSD + license_scan._BSD_END, "BSD-2-Clause"), (_bare(license_scan._BSD + license_scan._BSD_NAMES + license_scan._BSD_END), "BSD-3-Clause"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Released under the MIT License.", "MIT"),
])
def test_versions_are_told_apart(text, want):
    rng = random.Random(4)
    assert _licenses(f"{_noise(rng, 60)}. {text} {_noise(rng, 60)}") == {want}


_APACHE_LIKE = "(the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
_GPL_LIKE = "This {} is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_CLEAR = "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE. "


@pytest.mark.parametrize(("text", "want"), [
    ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at", "EPL-1.0"),
    ("Licensed under the Solderpad Hardware License, Version 2.0 " + _APACHE_LIKE, "unknown variant of Apache"),
    ("Licensed under the Educational Community License, Version 2.0 " + _APACHE_LIKE, "ECL-2.0"),
    (_GPL_LIKE.format("program", "GNU General Public License", "1"), "GPL-1.0"), (_GPL_LIKE.format("library", "GNU Library General Public License", "2"), "LGPL-2.0"),
    (_GPL_LIKE.format("program", "GNU General Public License", "4"), "unknown variant of GPL"), (_GPL_LIKE.format("library", "GNU Lesser General Public License", "2.1"), "LGPL-2.1"),
    (_bare(license_scan._BSD + license_scan._BSD_ADVERTISING + license_scan._BSD_NAMES + license_scan._BSD_END), "BSD-4-Clause"),
    (_bare(license_scan._BSD + license_scan._BSD_NAMES + _CLEAR + license_scan._BSD_END), "unknown variant of BSD"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
    ("This work is licensed under a Creative Commons Attribution 5.0 International License.", "unknown variant of CC-BY"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1 " + _APACHE_LIKE, "MPL-1.1"),
    ("Licensed under the Apache Software License, Version 1.1.", "Apache-1.1"), ("Licensed under the EUPL, Version 1.2.", "EUPL-1.2"), ("Licensed under the Apache License, Version 2.1.", "unknown variant of Apache"),
    (_bare(license_scan._MIT_GRANT + license_scan._MIT_NOTICE) + "The Software shall be used for Good, not Evil. " + license_scan._MIT_END, "unknown variant of MIT"),
])
def test_right_license_or_none(text, want):
    """Notices of licenses outside the list name no license of it."""
    rng = random.Random(8)
    assert _licenses(f"{_noise(rng, 60)}. {text} {_noise(rng, 60)}") == {want}
    assert _licenses(text) == {want}


@pytest.mark.parametrize("at_once", [300, 2000, 60_000])
def test_stretches_don_t_change_the_result(at_once):
    rng = random.Random(5)
    groups = GROUPS
    every = [_bare(t) for ts in license_scan.TEMPLATES.values() for t in ts]
    by_set = {(n, tuple(np.unique(license_scan.shingles(_bare(t))))): t for n, ts in license_scan.TEMPLATES.items() for t in ts}
    texts = [None, "", "one", *[_noise(rng, rng.randrange(400)) + " " + rng.choice(every) + " " + _noise(rng, rng.randrange(900)) for _ in range(30)], " ".join(_noise(rng, 500) + " " + t for t in every[::3])]
    got = sorted(license_scan.found(texts, groups, at_once=at_once))
    # Brute force: every window of every template, without hashes; each must be found, and the same one be the best.
    want = []
    for i, t in enumerate(texts):
        s = license_scan.shingles(t) if t else np.empty(0, np.uint64)
        w_ = re.findall(r"[^\W_]+", (t or "").lower())
        own = []
        for g in groups:
            for a in range(0, len(s), g.block):
                w = set(s[a : a + 3 * g.block].tolist())
                for name, x in zip(g.names, g.sets, strict=True):
                    same = len(w.intersection(x.tolist()))
                    if same >= 0.8 * len(x):
                        label = license_of(name, by_set[name, tuple(x)], w_[a : a + 3 * g.block + 1])
                        own.append((0, label, a, min(a + 3 * g.block, len(s)), same / len(x), same, label == name and not name.startswith("unknown")))
        if own:
            want += [(i, *x) for x in license_scan._decided(own)]
    assert got == sorted(want)
