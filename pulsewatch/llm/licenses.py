"""License scan by canonical digests (operator 4).

Known licences and license statements are brought to a canonical form (case,
punctuation, copyright lines, equivalent spellings, white space) and digested;
so is every whole text, every paragraph (run of lines without an empty one) and
every line of the documents.  A hash join on the digests finds the texts that
are a known licence whole.  Short licences and file headers are listed as texts, long
licences as digests of their usual forms.  A text whose canonical form begins with a word that
no known text begins with can't be equal to one, and that word is known from its
first letters: such texts are told apart before the canonical form is made.  The known table is a fixed list of a few hundred rows,
so it is broadcast whatever the size of the documents, and nothing else moves
but the rows that match.

Defined results: a NULL or empty text, or one without letters and digits, has
no digest and matches nothing; repeated rows of one doc_id are one document; a
NULL doc_id is one document; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

# Spellings that licence texts use for the same word.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "modelled": "modeled",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "https": "http",
}

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so")
_MIT_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_MIT_KEEP = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in "
    "all copies or substantial portions of the Software. ")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted{keep}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. ")
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ")
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
    "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
    "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
    "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    "software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.")
_APACHE_HEAD = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at")
_APACHE_URL = " http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_AS_IS = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
    "the specific language governing permissions and limitations under the License.")
_MPL_HEAD = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")


def headers() -> list[tuple[str, str]]:
    """(licence id, text) of the usual file headers: whole, and the paragraph
    that names the licence."""
    out = [("Apache-2.0", _APACHE_HEAD + x) for x in ("", _APACHE_URL, _APACHE_URL + _APACHE_AS_IS)]
    out += [("MPL-2.0", _MPL_HEAD), ("MPL-2.0", _MPL_HEAD.replace("http://", "http://www."))]
    for licence, name, version in (("GPL-2.0", "GNU General Public License", 2), ("GPL-3.0", "GNU General Public License", 3),
                                   ("LGPL-3.0", "GNU Lesser General Public License", 3),
                                   ("LGPL-2.1", "GNU Lesser General Public License", 2.1),
                                   ("LGPL-2.0", "GNU Library General Public License", 2),
                                   ("GPL-1.0", "GNU General Public License", 1),
                                   ("AGPL-3.0", "GNU Affero General Public License", 3)):
        by = " as published by the Free Software Foundation"
        for what in ("program", "library", "software", "file"):
            for terms in (f"{by}; either version {version} of the License, or (at your option) any later version.",
                          f"{by}, either version {version} of the License, or any later version.",
                          f"{by}; version {version} of the License.", f"{by}, version {version}.",
                          f" version {version}{by}.", f", version {version},{by}."):
                first = (f"This {what} is free software; you can redistribute it and/or modify it under the terms of the "
                         f"{name}{terms}")
                second = (f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                          f"even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} "
                          "for more details.")
                third = f" You should have received a copy of the {name} along with this {what}"
                post = "; if not, write to the Free Software Foundation, Inc., "
                ends = ("", ". If not, see <https://www.gnu.org/licenses/>.", "; if not, see <https://www.gnu.org/licenses/>.",
                        f"{post}51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
                        f"{post}59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")
                out += [(licence, first), (licence, first + second), *((licence, first + second + third + e) for e in ends)]
    return out


def statements() -> list[tuple[str, str]]:
    """(licence id, sentence) of the usual one-line statements."""
    names = {
        "MIT": ["MIT License", "The MIT License"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
        "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
        "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
        "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
        "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
        "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"],
        "GFDL-1.3": ["GNU Free Documentation License, version 1.3"],
        "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
        "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
        "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
        "ISC": ["ISC License"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    }
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("3.0", "4.0"):
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"CC-{kind}-{version}", f"a CC {kind} {version} license"]
    heads = ("Licensed under", "Released under", "Distributed under", "This work is licensed under",
             "This file is licensed under", "This software is licensed under", "This project is licensed under")
    out = []
    for licence, spellings in names.items():
        out += [(licence, f"SPDX-License-Identifier: {licence}{end}") for end in ("", "-only", "-or-later")]
        for spelling in spellings:
            for head in heads:
                out += [(licence, f"{head} {spelling}"), (licence, f"{head} the {spelling}")]
    return out


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the licences that are known whole, and statements."""
    return [
        ("MIT", _MIT_GRANT + _MIT_KEEP + _MIT_AS_IS), ("MIT", "MIT License\n" + _MIT_GRANT + _MIT_KEEP + _MIT_AS_IS),
        ("MIT-0", _MIT_GRANT + ". " + _MIT_AS_IS),
        ("ISC", _ISC.format(keep=", provided that the above copyright notice and this permission notice appear in all copies")),
        ("0BSD", _ISC.format(keep="")),
        ("BSD-2-Clause", _BSD_HEAD + _BSD_AS_IS), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_AS_IS),
        ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + " For more information, please refer to <https://unlicense.org/>"),
        ("Unlicense", _UNLICENSE + " For more information, please refer to <http://unlicense.org>"),
        *statements(), *headers(),
    ]


# (licence id, first word, digest) of the forms() of long licences, made from the
# files of Debian's /usr/share/common-licenses.
DIGESTS = (
    ("Apache-2.0", "apache", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Apache-2.0", "apache", "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad"),
    ("Apache-2.0", "apache", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca"),
    ("Apache-2.0", "apache", "594673f8fe0542761280c31fa6f0d1eca9f491e533af6c2c1fef40b1c4229b47"),
    ("Apache-2.0", "apache", "36229a9956938571a99113d590fb0e618aa4a86f7ddbf0874bba96f83a26a8a5"),
    ("Apache-2.0", "apache", "e80c728dad9283541363fd9f60e4c0527fadc838f92f45f514c14da7f0a481ad"),
    ("GPL-2.0", "gnu", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "gnu", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0", "gnu", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-2.0", "gnu", "b7f81dc9aaaa645304fde476859dc46db4e23b83ec1c50bd8462652ff46110c9"),
    ("GPL-2.0", "gnu", "c928252f428993b646c70c671425ec87aab1bc5abf42e7a179685a96469bd918"),
    ("GPL-2.0", "gnu", "19329ee16e4a9fb2e74ce40708e49f5c315b4f0ac4653c556ca42027ba79f9f5"),
    ("GPL-3.0", "gnu", "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"),
    ("GPL-3.0", "gnu", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee"),
    ("GPL-3.0", "gnu", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975"),
    ("GPL-3.0", "gnu", "1aa302d1c51bbd44fb8e420c3e50c67ac439d124cb536c551aba9ffd330b6b7c"),
    ("GPL-3.0", "gnu", "f4ef841ad817ef1f3aa483ee10cda8ce0398c1afa483f6ed9a3594bfd0ee9957"),
    ("GPL-3.0", "gnu", "45c34eadc75c338cdb10211ee6f4d0ba1b99b4cbcb9721b0f7640ed84ece56e0"),
    ("LGPL-3.0", "gnu", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0", "gnu", "1fdae0f4baa65e02972a2582f7faa32be3d5745ce89af111d72038a846b4daf7"),
    ("LGPL-3.0", "gnu", "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8"),
    ("LGPL-3.0", "gnu", "e7cce711588b9c58321bb2fe0fe9e3dc7d914c04eea82fc58e4b8f2834c47f8a"),
    ("MPL-2.0", "mozilla", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "mozilla", "6c03c950a0e42983bd33cc0408b2ade216964d45345c9a9e88e15a163509fc0f"),
    ("MPL-2.0", "mozilla", "958f21dc8dffc8ff8e2cd52fee0a8a694d6cbc45344ba2aa6e9802e632a8fc03"),
    ("MPL-2.0", "mozilla", "a11b27981d78130ab3f14c870f52d4a72cfca4c91846b373aee7266074ddb9a2"),
    ("CC0-1.0", "creative", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC0-1.0", "creative", "1651920f0c900f846b9305ee6da641be0057c3edded63157353e0d2d60a2cfa9"),
    ("LGPL-2.1", "gnu", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-2.1", "gnu", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-2.1", "gnu", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1", "gnu", "6d05f602d7a9f9950f9537100bd504a7fdab92cfe89f4f94b0d15721ee014b1f"),
    ("LGPL-2.1", "gnu", "98ee2ec068a51049ed400919bcc9b031bd9fcb4141726f51e23b5f0196a2d37a"),
    ("LGPL-2.1", "gnu", "9c8aea52ac2706a35452528904b5cef7c0aa4140e5ec04d54ba60f53c4a5c78b"),
    ("LGPL-2.0", "gnu", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.0", "gnu", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.0", "gnu", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.0", "gnu", "e7ecb08f240f58455c2c9090ab912b4bb92385869e21cf6d5eddcdcfc74a1731"),
    ("LGPL-2.0", "gnu", "f51728eb856e51e6247d4a023256f9cb9322abe784bdb65ecb82131ef29bfcee"),
    ("LGPL-2.0", "gnu", "052bf540c98a4842bad8d9f2b372e7225b1eb1d38da3916a60bc288db5e37152"),
    ("GPL-1.0", "gnu", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-1.0", "gnu", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "gnu", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "gnu", "175f511abd0d3fd5f48cd40e0aaac24652ada233ca289e42f8ffdc9dd5eb8a0e"),
    ("GPL-1.0", "gnu", "37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b"),
    ("GPL-1.0", "gnu", "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d"),
    ("GFDL-1.2", "gnu", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.2", "gnu", "75839ab241e1cbb20f99e8ad354d337c5a681dbe5ea8922b9c6bbd1ae80f89f1"),
    ("GFDL-1.2", "gnu", "24984a15a79852251f41674cbf7d55bce4ae838d119f0d6948fa83a46585ab5d"),
    ("GFDL-1.2", "gnu", "62637ac5e6f0bf25816fc99878f2a15681a53cf097fe676c0cf6c0ceae7da289"),
    ("GFDL-1.3", "gnu", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GFDL-1.3", "gnu", "413bceb4913dcabd3c7f903efac90d7bd89056bb797c366e98a16be9f25dc4dc"),
    ("GFDL-1.3", "gnu", "bc882955885bd3e89f2ef05a0446e40db189a071714b8f691921a6f55721269c"),
    ("GFDL-1.3", "gnu", "f06a3f640506b30b4b36aece853af150ddd2e233f4197d966c5be0b0d616b5ac"),
    ("Artistic-1.0-Perl", "the", "ddb49d591ecc4f65a223b9f53f330918100c323532a653c090d21b38e35a3a42"),
    ("Artistic-1.0-Perl", "the", "b915346f30aaec58ea904cecc639de26ca8bb0d073e155827b6369a92ac52fae"),
    ("Artistic-1.0-Perl", "the", "64caa863a014ced5a19878968026b7ed048dade5f4100313d358f6c3072f1cd1"),
    ("Artistic-1.0-Perl", "the", "9356b256dad0db187b0763f85291d43356937b7cfc98d7b797aa062417fa97db"),
    ("MPL-1.1", "mozilla", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-1.1", "mozilla", "e004ad18098cefd61a8ed2b436a81b5cba8b5f8d6f22a108d2e5e19e95feebec"),
    ("MPL-1.1", "mozilla", "286531471d44d2304f376f72d62a3573a9a54a8693a2d7cc3c3ed45fd567e8c5"),
    ("MPL-1.1", "mozilla", "7b0a65e493840d161bca54ae9f5ee753fdf65ee8755b10739c4a6e4e657644cc"),
    ("BSD-3-Clause", "all", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("BSD-3-Clause", "all", "c75be4fc49847c1a69bbd3e322553219ac85f45bc9f48607bc7764b82b05e838"),
    ("BSD-3-Clause", "redistribution", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "redistribution", "4672342e7dea62ff9f3d60290a74a2e3d232de6d1b323d0b3172aa70dc5439ae"),
)


_COPYRIGHT = re.compile(r"^[\W_]*?(?:copyright|\(c\)|©).*$", re.M)
_JOINED = re.compile(r"(?<=\S)-\s*\n\s*(?=\S)|\bnon-(?=commercial)|\bsub-(?=licen)")
_MARKS = re.compile(r"[\W_]+")
_FIRST = re.compile(r"[^\W_]+")


def canonical(text: str) -> str:
    """Lower case, no copyright lines, one spelling, single spaces between runs
    of letters and digits."""
    t = _JOINED.sub("", _COPYRIGHT.sub(" ", text.lower()))
    return " ".join([EQUIVALENT.get(w, w) for w in _MARKS.sub(" ", t).split()])


def digest(text: str) -> str | None:
    c = canonical(text)
    return hashlib.sha256(c.encode()).hexdigest() if c else None


def forms(text: str) -> list[str]:
    """Usual forms of a long licence: with and without what follows its terms,
    its paragraphs wrapped as they are or each in one line."""
    out = [text, re.split(r"\n[ \t]*END OF TERMS AND CONDITIONS", text)[0]]
    out.append(out[1] + "\nEND OF TERMS AND CONDITIONS\n")
    return out + ["\n\n".join(" ".join(x.split()) for x in re.split(r"\n[ \t\r]*\n\s*", t)) for t in out]


def beginnings(texts: Iterable[str]) -> frozenset[str]:
    """Every first part of a spelling of a word that a text begins with."""
    first = {c.split(" ")[0] for c in map(canonical, texts) if c}
    first |= {w for w, same in EQUIVALENT.items() if same in first}
    return frozenset(w[:n] for w in first for n in range(1, len(w) + 1))


def may_be_known(text: str, begins: frozenset[str]) -> bool:
    """False only if the canonical form begins like no known text."""
    m = _FIRST.search(text)
    if m and ((w := m[0].lower()).startswith("copyright") or w == "c" or "©" in text[:m.start()]):
        m = _FIRST.search(_COPYRIGHT.sub(" ", text.lower()))  # what follows the copyright lines decides
    return bool(m) and m[0].lower() in begins


def units(text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is the entire text, text) of the text, its paragraphs and lines."""
    yield True, text
    lines = text.split("\n")
    if len(lines) > 1:
        yield from ((False, x) for x in lines)
        paragraphs = re.split(r"\n[ \t\r]*\n\s*", text)
        if len(paragraphs) > 1:
            yield from ((False, x) for x in paragraphs)


def known(spark: SparkSession, texts: list[tuple[str, str]], digests: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
    """(digest, licence) of the known list, one row a digest."""
    rows = {d: licence for licence, _, d in digests}
    for licence, text in sorted(texts, reverse=True):
        if d := digest(text):
            rows[d] = licence
    return spark.createDataFrame(sorted(rows.items()), "digest string, licence string")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
         texts: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, licence, whole, n): licences of each document, whether one is its
    entire text, and how many of its texts, paragraphs and lines are it.

    ``texts``: (licence, text) pairs to know instead of the built-in list.
    """
    ship(docs.sparkSession)
    digests = DIGESTS if texts is None else ()
    texts = list(known_texts() if texts is None else texts)
    begins = beginnings([*(t for _, t in texts), *(first for _, first, _ in digests)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import licenses as L
        for batch in batches:
            ids, whole, digests = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for entire, x in L.units(t.as_py() or ""):
                    if L.may_be_known(x, begins):
                        ids.append(i)
                        whole.append(entire)
                        digests.append(L.digest(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(whole, pa.bool_()), pa.array(digests, pa.string())],
                names=["doc_id", "whole", "digest"])

    picked = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    found = picked.mapInArrow(run, "doc_id bigint, whole boolean, digest string")
    hits = found.join(F.broadcast(known(docs.sparkSession, texts, digests)), "digest")
    return hits.groupBy("doc_id", "licence").agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
