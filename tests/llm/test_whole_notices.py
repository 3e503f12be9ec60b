"""Licence notices wrapped over lines, and other versions of known ones."""

import textwrap

from explorium.llm import licenses

LONG = {
    "mit": 'Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
}
SHORT = {"SPDX-License-Identifier: BSD-2-Clause": "bsd", "SPDX-License-Identifier: GPL-2.0-only": "gpl", "SPDX-License-Identifier: LGPL-3.0-only": "lgpl", "Licensed under the GNU GPL v2": "gpl", "Licensed under CC BY 3.0": "cc-by",
         "Apache License 2.0": "apache", "BSD 3-Clause License": "bsd", "Released under GPLv2 or later": "gpl", "Available under MPL 2.0": "mpl", "CC-BY-SA 3.0": "cc-by-sa"}


def test_wrapped_notices_and_versions(spark):
    model = licenses.train(["some words of a document", "and of another one"])
    rows, want = [], {}
    for name, text in LONG.items():
        for width in (40, 72):
            for mark in ("", " * ", "# ", "// "):
                body = "\n".join(mark + x for part in text.split("\n") for x in (textwrap.wrap(part, width) or [""]))
                want[len(rows)] = [name]
                rows.append((len(rows), f"words before\n\n{body}\n\nwords after"))
    for text, name in SHORT.items():
        want[len(rows)] = [name]
        rows.append((len(rows), text))
    for text in ("All rights\n\nreserved", "the terms\nof the work\nas published by the\ngeneral public"):
        want[len(rows)] = []
        rows.append((len(rows), text))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(rows[k][1], got[k].licenses, w) for k, w in want.items() if got[k].licenses != w] == []
    assert all(got[k].n_paragraphs == 1 for k in want if rows[k][1] in SHORT)


def test_texts_without_a_key_hold_no_template():
    """By brute force: every set of a template's bigrams that would be enough touches a key."""
    for own, _ in licenses._EVERY:
        free = [two for two in own if not any(licenses._KEYS.search(w) for w in two)]
        assert len(free) < licenses.CONTAINED * len(own)
