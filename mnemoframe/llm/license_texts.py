"""Texts of licences and their usual notices, by SPDX identifier. Fixed values.

Short licences stand whole; of the long ones the title, the opening and the
header that their own instructions put into source files.
"""

from __future__ import annotations

import re

_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
"""
_BSD_2 = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""
_UNLICENSE = """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
"""
_APACHE_HEADER = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.
"""
_BOOST = """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
_ZERO_BSD = _ISC.replace(",\nprovided that the above copyright notice and this permission notice appear in all copies.", ".")
_EPL_HEADER = """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
is available at https://www.eclipse.org/legal/epl-2.0/
"""
_FREE = """
This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License as published by the Free Software Foundation{mark2} either version {version} of the License, or (at your
option) any later version.
"""
_NO_WARRANTY = """
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
"""
_MPL_HEADER = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
_GPL_2 = _FREE.format(what="program", mark=";", mark2=";", kind="", version="2")
_GPL_3 = _FREE.format(what="program", mark=":", mark2=",", kind="", version="3")
_AGPL_3 = _FREE.format(what="program", mark=":", mark2=",", kind="Affero ", version="3")
_LGPL_2 = _FREE.format(what="library", mark=";", mark2=";", kind="Lesser ", version="2.1")
_LGPL_3 = _FREE.format(what="program", mark=":", mark2=",", kind="Lesser ", version="3")

TEXTS: dict[str, tuple[str, ...]] = {
    "0BSD": ("Released under the Zero-Clause BSD License (0BSD)", _ZERO_BSD),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _AGPL_3, _AGPL_3 + _NO_WARRANTY.replace("GNU", "GNU Affero")),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE_HEADER),
    "Artistic-2.0": ("Licensed under the Artistic License 2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License", _BSD_2 + _BSD_END),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License", _BSD_2 + _BSD_NAMES + _BSD_END),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003", _BOOST),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0", "Eclipse Public License - v 2.0", _EPL_HEADER),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GPL_2, _GPL_2 + _NO_WARRANTY),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GPL_3, _GPL_3 + _NO_WARRANTY),
    "ISC": ("Released under the ISC License", _ISC),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _LGPL_2, _LGPL_2 + _NO_WARRANTY.replace("program", "library").replace("GNU", "GNU Lesser")),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _LGPL_3, _LGPL_3 + _NO_WARRANTY.replace("GNU", "GNU Lesser")),
    "MIT": ("Released under the MIT License", _MIT + _WARRANTY, "The MIT License (MIT)" + _MIT + _WARRANTY),
    "MPL-2.0": ("Licensed under the Mozilla Public License, Version 2.0", "Mozilla Public License Version 2.0", _MPL_HEADER),
    "Proprietary": ("All rights reserved",),
    "Zlib": ("Released under the zlib License", _ZLIB),
    "Unlicense": ("Released into the public domain under the Unlicense", _UNLICENSE),
}
TEXTS = {name: (*texts, *([] if name == "Proprietary" else [f"SPDX-License-Identifier: {name}"])) for name, texts in TEXTS.items()}

#: The version that a licence's texts must not gainsay, in both spellings; whole numbers also stand alone.
VERSIONS = {name: found for name in TEXTS if (found := re.findall(r"-(\d\.\d)$", name))}
VERSIONS = {name: [v, v.removesuffix(".0")] for name, (v,) in VERSIONS.items()}
