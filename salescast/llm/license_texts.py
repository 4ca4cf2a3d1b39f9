"""Titles, file headers and whole texts of licences, for the comparison with blocks and licence files."""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any
person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works
of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:"""
_BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights
to this software to the public domain worldwide. This software is distributed without any warranty. You should have
received a copy of the CC0 Public Domain Dedication along with this software. If not, see
http://creativecommons.org/publicdomain/zero/1.0/."""
_FSF_COPYING = """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it
is not allowed."""

_GNU = {
    "GPL-3.0": ("General", "3", "Version 3, 29 June 2007 Copyright (C) 2007"),
    "LGPL-3.0": ("Lesser General", "3", "Version 3, 29 June 2007 Copyright (C) 2007"),
    "AGPL-3.0": ("Affero General", "3", "Version 3, 19 November 2007 Copyright (C) 2007"),
    "GPL-2.0": ("General", "2", "Version 2, June 1991 Copyright (C) 1989, 1991"),
    "LGPL-2.1": ("Lesser General", "2.1", "Version 2.1, February 1999 Copyright (C) 1991, 1999"),
}
_CC = {
    "CC-BY-4.0": "Attribution",
    "CC-BY-SA-4.0": "Attribution-ShareAlike",
    "CC-BY-NC-4.0": "Attribution-NonCommercial",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
}
# Texts of the licences' publishers, one file each.
WHOLE = ("Apache-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "GPL-2.0", "LGPL-2.1")


def _gnu(license_: str) -> list[tuple[str, str]]:
    name, version, dated = _GNU[license_]
    title = f"GNU {name} Public License"
    terms = f"""This program is free software: you can redistribute it and/or modify it under the terms of the {title}
    as published by the Free Software Foundation, either version {version} of the License, or (at your option) any
    later version."""
    rest = f"""This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details. You should
    have received a copy of the {title} along with this program. If not, see <https://www.gnu.org/licenses/>."""
    version_and_date = dated.split(" Copyright")[0]
    foundation = f"{title} {dated} Free Software Foundation, Inc."
    # Version 3 has its one-sentence notices in the scan's own templates.
    notices = [] if version == "3" else [f"This work is licensed under the {title}, version {version}."]
    headers = [f"{title} {version_and_date}", f"{foundation} {_FSF_COPYING}", terms, f"{terms} {rest}"]
    return [(license_, text) for text in notices + headers]


@lru_cache(maxsize=1)
def texts() -> tuple[tuple[str, str], ...]:
    """(license, text), in order of preference on equal cosine."""
    folder = files(__package__) / "licenses"
    rows = [
        ("MIT", "MIT License"),
        ("MIT", "The MIT License (MIT)"),
        ("MIT", _MIT_GRANT),
        ("MIT", f"MIT License {_MIT_GRANT} {_MIT_REST}"),
        ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
        ("Apache-2.0", _APACHE),
        ("MPL-2.0", "Mozilla Public License Version 2.0"),
        ("MPL-2.0", _MPL),
        ("BSD-3-Clause", "BSD 3-Clause License"),
        ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_2} {_BSD_3}"),
        ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_2} {_BSD_3} {_BSD_REST}"),
        ("BSD-2-Clause", "BSD 2-Clause License"),
        ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
        ("BSD-2-Clause", f"{_BSD_OPENING} {_BSD_2}"),
        ("BSD-2-Clause", f"{_BSD_OPENING} {_BSD_2} {_BSD_REST}"),
        ("CC0-1.0", "CC0 1.0 Universal"),
        ("CC0-1.0", _CC0),
        ("ISC", "ISC License"),
        ("ISC", _ISC),
        ("BSL-1.0", _BOOST),
        ("Unlicense", _UNLICENSE),
    ]
    for license_ in _GNU:
        rows += _gnu(license_)
    for license_, name in _CC.items():
        rows.append((license_, f"Creative Commons {name} 4.0 International Public License"))
        rows.append((license_, f"This work is licensed under a Creative Commons {name} 4.0 International License."))
        rows.append((license_, f"Licensed under {license_[:-4].replace('-', ' ', 1)} 4.0."))
    rows += [(license_, (folder / f"{license_}.txt").read_text("utf-8")) for license_ in WHOLE]
    return tuple(rows)


# What several licences begin with: it counts for this one if a file has nothing more telling.
OPENINGS = (("BSD-3-Clause", _BSD_OPENING),)
