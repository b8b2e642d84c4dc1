"""Known licences beyond license_scan's own short list, from public names and texts and not from any data.

``texts()``: the whole texts in licenses/, under their SPDX ids. ``NOTICES``: one-line notices, each name of a licence in
each usual wording, SPDX tags, and lines of the standard headers that name a licence by themselves.
"""

from __future__ import annotations

from pathlib import Path

_GNU = (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License"), ("GFDL", "Free Documentation License"))
_VERSIONS = {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.1", "3.0"), "AGPL": ("3.0",), "GFDL": ("1.1", "1.2", "1.3")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _names() -> dict[str, list[str]]:
    """SPDX id -> the names that a notice may use."""
    out = {
        "MIT": ["the MIT License", "MIT", "the MIT/Expat License", "the Expat License"],
        "ISC": ["the ISC License", "ISC"],
        "0BSD": ["the Zero-Clause BSD License", "the BSD Zero Clause License", "0BSD"],
        "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "the FreeBSD License", "BSD-2-Clause"],
        "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License", "BSD-3-Clause"],
        "BSD-4-Clause": ["the BSD 4-Clause License", "the 4-Clause BSD License", "the Original BSD License", "BSD-4-Clause"],
        "Apache-1.1": ["the Apache License, Version 1.1", "the Apache Software License, Version 1.1", "Apache-1.1"],
        "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache Software License, Version 2.0", "the Apache 2.0 License", "the Apache License v2.0", "Apache 2.0", "Apache-2.0"],
        "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"],
        "Zlib": ["the zlib License", "the zlib/libpng License"],
        "Unlicense": ["the Unlicense"],
        "WTFPL": ["the WTFPL", "the Do What The Fuck You Want To Public License"],
        "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0-1.0"],
        "Artistic-2.0": ["the Artistic License 2.0", "the Artistic License, Version 2.0", "Artistic-2.0"],
        "CDDL-1.0": ["the Common Development and Distribution License, Version 1.0", "CDDL 1.0"],
        "EUPL-1.2": ["the European Union Public Licence, Version 1.2", "the EUPL, Version 1.2", "EUPL-1.2"],
        "OFL-1.1": ["the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1"],
        "ODbL-1.0": ["the Open Database License, Version 1.0", "the Open Data Commons Open Database License", "the ODbL 1.0"],
    }
    for v in ("1.1", "2.0"):
        out[f"MPL-{v}"] = [f"the Mozilla Public License, Version {v}", f"the Mozilla Public License {v}", f"the Mozilla Public License, v. {v}", f"the MPL {v}", f"MPL {v}"]
    for v in ("1.0", "2.0"):
        out[f"EPL-{v}"] = [f"the Eclipse Public License, Version {v}", f"the Eclipse Public License {v}", f"the Eclipse Public License v{v}", f"EPL {v}"]
    for short, long in _GNU:
        for v in _VERSIONS[short]:
            names = []
            for w in dict.fromkeys((v, v.removesuffix(".0"))):
                names += [f"the GNU {long}, version {w}", f"the GNU {short} version {w}", f"the {short} version {w}", f"{short} version {w}", f"{short}v{w}", f"the {short}v{w}"]
            out[f"{short}-{v}-only"] = [*names, *[f"{n} only" for n in names]]
            out[f"{short}-{v}-or-later"] = [f"{n} or {x}" for n in names for x in ("later", "any later version")]
    for kind, long in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spdx = f"CC-{kind}-{v}"
            whole = f"Creative Commons {long} {v}"
            out[spdx] = [f"CC {kind} {v}", f"CC-{kind} {v}", whole, *[f"{a} {whole} {b}".strip() for a in ("a", "the") for b in ("License", "International License" if v == "4.0" else "Unported License")]]
    return out


_WORDINGS = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "Published under {}", "Licensed under the terms of {}", "Distributed under the terms of {}",
    "This work is licensed under {}", "This software is licensed under {}", "This program is licensed under {}", "This project is licensed under {}", "This file is licensed under {}", "This software is released under {}",
)
#: Of the standard headers: lines that name the licence by themselves.
_HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("LicenseRef-all-rights-reserved", "All rights reserved worldwide."),
)


def _notices() -> tuple[tuple[str, str], ...]:
    out = list(_HEADERS)
    for spdx, names in _names().items():
        out += [(spdx, f"SPDX-License-Identifier: {spdx}"), (spdx, f"License: {spdx}")]
        out += [(spdx, w.format(n)) for n in dict.fromkeys(names) for w in _WORDINGS]
    return tuple(dict.fromkeys(out))


NOTICES = _notices()


def texts() -> tuple[tuple[str, str], ...]:
    return tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
