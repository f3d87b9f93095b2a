"""Texts of common licences, for the digest lookup.

Fixed values: the wording is that of the licences; the long ones lie in ``licences/``. A
caller may give a table of further texts; lines that name a holder or a year do not matter.
"""

import re
from importlib.resources import files

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS {or_holders}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so{rest}
"""

LICENCES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

""" + _ISC_END,
    "BSD-2-Clause": _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_TWO + _BSD_THIRD + _BSD_END,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + _ISC_END,
    "MIT": "MIT License\n\n" + _MIT_GRANT.format(rest=""", subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""") + "\n" + _AS_IS.format(or_holders="OR COPYRIGHT HOLDERS "),
    "MIT-0": "MIT No Attribution\n\n" + _MIT_GRANT.format(rest=".") + "\n" + _AS_IS.format(or_holders="OR COPYRIGHT HOLDERS "),
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Titles under which the short texts are found as well.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "ISC": ("ISC License", "ISC License (ISC)"),
    "MIT": ("The MIT License", "The MIT License (MIT)"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
}

#: The first paragraph of a text, and what ends the terms of some. Same in SQL.
TITLE = r"^\s*(?:[^\n]*\S[^\n]*\n)+\s*\n"
TERMS_END = "END OF TERMS AND CONDITIONS"
_TITLED = ("MIT", "MIT-0")


def short_forms() -> list[tuple[str, str]]:
    """(id, text) of the short licences, with each title and without."""
    out = []
    for name, text in LICENCES.items():
        bare = re.sub(TITLE, "", text, count=1) if name in _TITLED else text
        out += [(name, text)] + [(name, bare)] * (bare != text)
        out += [(name, f"{title}\n\n{bare}") for title in TITLES.get(name, ())]
    return out


def long_texts() -> list[tuple[str, str]]:
    """(id, text) of the long licences, as published."""
    found = [f for f in files(__package__).joinpath("licences").iterdir() if f.name.endswith(".txt")]
    return sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in found)


def long_forms(text: str) -> list[str]:
    """A text with and without its title, whole and up to the end of its terms."""
    titled = [text, re.sub(TITLE, "", text, count=1)]
    ended = [re.sub(f"{TERMS_END}[\\s\\S]*", end, t) for t in titled for end in (TERMS_END, "")]
    return list(dict.fromkeys(titled + ended))


def known_forms() -> list[tuple[str, str]]:
    return short_forms() + [(name, form) for name, text in long_texts() for form in long_forms(text)]
