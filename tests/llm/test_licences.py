"""Licence notices planted by hand: alone, wrapped, and among prose."""

import pytest

from tidemark.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
#: Notices without the words that notices mostly have.
PLAIN = [
    ("Distributed under the GNU GPL version 2.", "gpl", "0:gpl"),
    ("Shared under CC-BY-SA 4.0.", "cc-by-sa", "0:cc-by-sa"),
    ("Released under CC-BY 4.0", "cc-by", "0:cc-by"),
    ("Released under the BSD 3-Clause terms", "bsd", "0:bsd"),
    ("\n".join(MIT.split()[:30]), "mit", None),
]
HEADINGS = [
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "gpl", None), ("GNU GENERAL PUBLIC LICENSE Version 3", "gpl", "0:gpl"), ("License: MIT", "mit", "0:mit"), ("MIT License\n\nCopyright (c) 2020 A", "mit", None),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above", "isc", None),
    ("This is free and unencumbered software released into the public domain.", "unlicense", "0:unlicense"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "lgpl", None),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "mpl", None), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa", "0:cc-by-nc-sa"),
    ("The licence of the pub at MIT was renewed, and the public may use it.", "", ""), ("Permission was granted to the students to use the library for any purpose.", "", ""),
]
PLANTED = [
    ("All rights reserved.", "proprietary", "0:proprietary"),
    ("Ñga ezque de para co los.\nAll rights reserved.\nçèai queou", "proprietary", "1:proprietary"),
    (MIT, "mit", "0:mit"),
    ("Some words of prose\nbefore it.\n" + MIT + "\nand prose behind", "mit", None),
    ("Read me.\r\n\r\n" + BSD.replace("\n", "\r\n"), "bsd", "2:bsd"),
    ("The report is out. Licensed under CC BY 4.0. More on this later.", "cc-by", "0:cc-by"),
    ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", "cc-by-nc", "0:cc-by-nc"),
    ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", "apache,mit", "0:mit,1:apache"),
    ("A fishing licence costs ten dollars and the rights are reserved for members.", "", ""),
    (BSD.replace("\n", "\n\n").split("\n\n")[1], "", ""),
]


@pytest.mark.parametrize("notices", [PLANTED, PLAIN, HEADINGS])
def test_planted_notices(spark, notices):
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(notices)], "doc_id long, text string")
    for r in license_scan.scan(frame).collect():
        text, families, paragraphs = notices[r.doc_id]
        assert r.families == families and paragraphs in (None, r.paragraphs), (text, r)
        assert (r.n_license, r.families, r.paragraphs) == license_scan.scan_text(text)


def test_paragraphs_are_runs_of_lines(spark):
    frame = spark.createDataFrame([(0, "a\nb\n \t\r\nc\n\n\nd"), (1, "\n\n"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_paragraphs for r in license_scan.scan(frame).collect()} == {0: 3, 1: 0, 2: 0}


@pytest.mark.parametrize("least", [1, 2])
def test_cues_are_in_all_that_can_be_confirmed(least):
    cues = set(license_scan.cues(least))
    for lists in license_scan._templates().values():
        for t in lists:
            assert len(t) > 1 and (len(set(t) - cues) + least - 1) / len(t) < license_scan.CONFIRM, t
