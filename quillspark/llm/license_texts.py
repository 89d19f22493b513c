"""Whole licence texts for the scan: published texts, their titles and customary forms."""

from __future__ import annotations

import re
from importlib import resources

# Titles that stand above a text; a copyright notice between title and text doesn't count.
TITLES = {
    "MIT": ("MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License (MIT)"),
    "ISC": ("ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License",
             "BSD 0-Clause License", "BSD 0-Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD License", "The BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", "2-Clause BSD License",
                     "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "FreeBSD License",
                     "BSD 2-Clause License (BSD-2-Clause)"),
    "BSD-3-Clause": ("BSD License", "The BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "3-Clause BSD License",
                     "New BSD License", "Modified BSD License", "Revised BSD License",
                     'BSD 3-Clause "New" or "Revised" License', "BSD 3-Clause License (BSD-3-Clause)"),
    "Zlib": ("zlib", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0"),
    "GPL-2.0-only": ("GNU General Public License v2.0",), "GPL-3.0-only": ("GNU General Public License v3.0",),
    "LGPL-2.0-only": ("GNU Library General Public License v2",), "LGPL-2.1-only": ("GNU Lesser General Public License v2.1",),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0",),
    "MPL-2.0": ("Mozilla Public License 2.0",), "CC0-1.0": ("CC0 1.0 Universal",),
}

# Title lines of the texts in the folder ``texts``.
TITLE_LINES = {"Apache-2.0": 3, "GPL-2.0-only": 2, "GPL-3.0-only": 2, "LGPL-2.0-only": 2, "LGPL-2.1-only": 2, "LGPL-3.0-only": 2,
               "MPL-2.0": 2, "CC0-1.0": 2, "Unlicense": 0}
# A copy may end before or behind the first of these, or before the second.
TERMS, EXHIBIT = "END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form License Notice"
ADDRESS = r"51 Franklin Street, Fifth Floor, Boston,\s+MA\s+02110-1301,?\s+USA"
ADDRESSES = ("51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
             "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """3. Neither the name of {holder} nor the names of {its} contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {of}
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_OWNERS = (
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDER AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
    ("AUTHORS AND CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"),
    ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("AUTHOR", "AUTHOR"), ("AUTHORS", "AUTHORS"),
)
BSD_NAMES = (("the copyright holder", "its"), ("the copyright holders", "its"), ("the copyright holders", "their"),
             ("the University", "its"), ("the <organization>", "its"), ("the author", "its"), ("the author", "his"))

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""


def _clauses(text: str) -> list[str]:
    """Numbered clauses, clauses behind bullets, and lettered ones."""
    return [text, re.sub(r"(?m)^\d\. ", "* ", text), re.sub(r"(?m)^(\d)\. ", lambda m: f"({'abc'[int(m[1]) - 1]}) ", text)]


def published(license_id: str) -> tuple[str, str]:
    """(title, text) of a file of the folder ``texts``."""
    lines = (resources.files("quillspark.llm") / "texts" / f"{license_id}.txt").read_text("utf-8").strip().split("\n")
    at = 0
    for _ in range(TITLE_LINES[license_id]):
        at = next(k for k in range(at, len(lines)) if lines[k].strip()) + 1
    return "\n".join(lines[:at]), "\n".join(lines[at:])


def _forms(text: str) -> list[str]:
    """A published text, cut behind its terms, with other addresses, and with either kind of link."""
    out = [text]
    if TERMS in text:
        terms = text.split(TERMS)[0]
        out += [terms, terms + TERMS]
    if EXHIBIT in text:
        out.append(text.split(EXHIBIT)[0])
    out += [re.sub(ADDRESS, a, x) for x in out for a in ADDRESSES if re.search(ADDRESS, x)]
    return list(dict.fromkeys(y for x in out for y in (x, x.replace("http:", "https:"), x.replace("https:", "http:"))))


def whole_texts(short: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str], str]]:
    """(license_id, titles, text): each text counts under each of its titles, "" among them.

    ``short`` holds the texts (license_id, text) that are given elsewhere."""
    texts = list(short)
    for k, t in short:
        if k == "MIT":
            texts.append((k, t.replace("permission notice shall", "permission notice (including the next paragraph) shall")))
        elif k in ("ISC", "0BSD"):
            texts.append((k, t.replace("and/or distribute", "and distribute")))
    for by, of in BSD_OWNERS:
        end = BSD_END.format(by=by, of=of)
        texts += [("BSD-2-Clause", t) for t in _clauses(BSD_2 + end)]
        texts += [("BSD-3-Clause", t) for name, its in BSD_NAMES for t in _clauses(BSD_3.format(holder=name, its=its) + end)]
    texts += [("Zlib", t) for t in _clauses(ZLIB)]
    out = [(k, ["", *TITLES[k]], t) for k, t in texts]
    for k in TITLE_LINES:
        title, text = published(k)
        titles = ["", *TITLES[k], *dict.fromkeys((title, title.replace("http:", "https:")))]
        out += [(k, list(dict.fromkeys(titles)), t) for t in _forms(text)]
    return out
