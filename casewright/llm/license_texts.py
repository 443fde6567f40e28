"""Public license texts and notices that scans look for."""

# Phrases and the labels they give.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licenses and of the notices they recommend.
_WARRANTY_MIT = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_WARRANTY_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_NOTICE = """
This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
{name} for more details."""


def _short(name: str) -> tuple[str, ...]:
    """The usual one-line notices of a license."""
    return tuple(f"{start} {name}" for start in ("Released under the", "Licensed under the", "This work is licensed under the"))


def _gnu(name: str, version: str) -> tuple[str, ...]:
    return _GNU_NOTICE.format(name=name, version=version), *_short(f"{name}, version {version}")


def _cc(name: str, short: str, version: str) -> tuple[str, ...]:
    return (
        f"Licensed under {short} {version}", f"This work is licensed under {short} {version}",
        f"This work is licensed under a Creative Commons {name} {version} International License",
    )


TEMPLATES = {
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""" + _WARRANTY_MIT,
        *_short("MIT License"),
    ),
    "apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        *_short("Apache License, Version 2.0"),
    ),
    "bsd-2-clause": (_BSD_GRANT + _WARRANTY_BSD, *_short("BSD 2-Clause License")),
    "bsd-3-clause": (_BSD_GRANT + _BSD_NAMES + _WARRANTY_BSD, *_short("BSD 3-Clause License")),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        *_short("ISC License"),
    ),
    "gpl-2.0": _gnu("GNU General Public License", "2"),
    "gpl-3.0": _gnu("GNU General Public License", "3"),
    "lgpl-2.1": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0": _gnu("GNU Lesser General Public License", "3"),
    "agpl-3.0": _gnu("GNU Affero General Public License", "3"),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        *_short("Mozilla Public License, version 2.0"),
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    ),
    "cc0-1.0": _cc("CC0", "CC0", "1.0"),
    "cc-by-4.0": _cc("Attribution", "CC BY", "4.0"),
    "cc-by-sa-4.0": _cc("Attribution-ShareAlike", "CC BY-SA", "4.0"),
    "cc-by-nc-4.0": _cc("Attribution-NonCommercial", "CC BY-NC", "4.0"),
    "cc-by-nd-4.0": _cc("Attribution-NoDerivatives", "CC BY-ND", "4.0"),
    "cc-by-nc-sa-4.0": _cc("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA", "4.0"),
    "cc-by-nc-nd-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND", "4.0"),
}
