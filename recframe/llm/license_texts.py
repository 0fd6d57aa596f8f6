"""Wordings of public licences and of the notices that name them.

Each passage has the labels that it gives and the phrases that must stand with it. Long licences go by their usual notices and
by passages that only they hold; of short ones the text is given whole. Punctuation and case don't count.
"""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"""
_MIT_TERMS = """, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE
IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = """: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {name} for more details."""


def _gnu_short(name: str, version: str) -> str:
    return f"under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"


#: (labels, wording, mandatory phrases)
PASSAGES: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = (
    (("mit",), _MIT_GRANT, ("permission is hereby granted free of charge", "without restriction")),
    (("mit",), _MIT_GRANT + _MIT_TERMS, ("permission is hereby granted free of charge",)),
    (("mit",), "Released under the MIT License", ("the mit license",)),
    (("apache",), 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', ("apache license version 2 0",)),
    (("apache",), "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (("apache",), 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License', ("distributed under the license is distributed on an as is basis",)),
    (("apache",), "Each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", ("subject to the terms and conditions of this license", "prepare derivative works of")),
    (("gpl", "gpl-3.0"), _gnu("General Public License", "3"), ("gnu general public license", "either version 3 of the license")),
    (("gpl", "gpl-3.0"), _gnu_short("General Public License", "3"), ("gnu general public license", "either version 3 of the license")),
    (("gpl", "gpl-2.0"), _gnu("General Public License", "2"), ("gnu general public license", "either version 2 of the license")),
    (("gpl", "gpl-2.0"), _gnu_short("General Public License", "2"), ("gnu general public license", "either version 2 of the license")),
    (("gpl",), "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    (("lgpl", "lgpl-3.0"), _gnu_short("Lesser General Public License", "3"), ("gnu lesser general public license", "either version 3 of the license")),
    (("lgpl", "lgpl-2.1"), _gnu_short("Lesser General Public License", "2.1"), ("gnu lesser general public license", "either version 2 1 of the license")),
    (("agpl", "agpl-3.0"), _gnu_short("Affero General Public License", "3"), ("gnu affero general public license", "either version 3 of the license")),
    (("bsd",), _BSD_START, ("redistribution and use in source and binary forms", "following conditions are met")),
    (("bsd", "bsd-2-clause"), _BSD_START + _BSD_TWO + _BSD_END, ("following conditions are met", "materials provided with the distribution this software is provided by")),
    (("bsd", "bsd-3-clause"), _BSD_START + _BSD_TWO + _BSD_THREE + _BSD_END, ("following conditions are met", "may be used to endorse or promote products")),
    (("mpl",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    (("epl", "epl-2.0"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license",)),
    (("isc",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies")),
    (("0bsd",), 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS', ("for any purpose with or without fee is hereby granted the software is provided as is",)),
    (("zlib",), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("permission is granted to anyone to use this software for any purpose", "redistribute it freely")),
    (("bsl-1.0",), 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so', ("any person or organization obtaining a copy",)),
    (("unlicense",), "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    (("wtfpl",), "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ("public license", "changing it is allowed as long as the name is changed")),
    (("cc-by",), "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    (("cc-by",), "Licensed under CC BY 4.0", ("cc by 4 0",)),
    (("cc-by-sa",), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    (("cc-by-sa",), "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    (("cc-by-nc",), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    (("cc-by-nc",), "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    (("cc0",), "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    (("proprietary",), "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited", ("unauthorized copying of this file", "strictly prohibited")),
)
