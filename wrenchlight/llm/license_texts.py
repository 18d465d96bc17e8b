"""Known licences, one file each in ``known_licenses``, and one-line notices. Public licence texts, as published."""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).parent / "known_licenses"
TEXTS = {path.stem: path.read_text(encoding="utf-8") for path in sorted(FOLDER.glob("*.txt"))}

# Identifiers in the form that source files carry, and what people write in one line.
IDENTIFIERS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 Unlicense Zlib"
).split()
NOTICES = {
    **{f"{name} (identifier)": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS},
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT (licensed)": "Licensed under the MIT License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 (licensed)": "Licensed under the GNU General Public License v2.0.",
    "GPL-3.0 (licensed)": "Licensed under the GNU General Public License v3.0.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License v2.1.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License v3.0.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License v3.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "ISC": "Licensed under the ISC License.",
    "Apache-2.0 (released)": "Released under the Apache License 2.0.",
}
