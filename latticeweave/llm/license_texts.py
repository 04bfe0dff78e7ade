"""Texts of public licences and their usual notices, with the phrases that must stand in each.

Each entry: label, text, key phrases (any number, in words of the text).
"""

MIT_TEXT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

ISC_TEXT = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

BSD_2_TEXT = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""

BSD_3_TEXT = BSD_2_TEXT + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
"""

UNLICENSE_TEXT = """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.
"""

BOOST_TEXT = """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,
and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
"""

ZLIB_TEXT = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:
"""

APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""

GPL_NOTICE = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
"""

MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at http://mozilla.org/MPL/2.0/.
"""

EPL_NOTICE = """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""

TEMPLATES = (
    ("mit", MIT_TEXT, ("permission is hereby granted free of charge", "substantial portions of the software")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("isc", ISC_TEXT, ("permission to use copy modify and or distribute this software",)),
    ("isc", "Licensed under the ISC License", ("isc license",)),
    ("bsd", BSD_2_TEXT, ("redistribution and use in source and binary forms",)),
    ("bsd", BSD_3_TEXT, ("redistribution and use in source and binary forms", "endorse or promote products")),
    ("bsd", "Licensed under the BSD 3-Clause License", ("bsd 3 clause license",)),
    ("unlicense", UNLICENSE_TEXT, ("free and unencumbered software",)),
    ("boost", BOOST_TEXT, ("any person or organization obtaining a copy",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("zlib", ZLIB_TEXT, ("alter it and redistribute it freely",)),
    ("apache-2", APACHE_NOTICE, ("apache license version 2 0",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    ("gpl-2", GPL_NOTICE.format(2), ("gnu general public license", "either version 2")),
    ("gpl-3", GPL_NOTICE.format(3), ("gnu general public license", "either version 3")),
    ("gpl-2", "Licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "Licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    ("mpl-2", MPL_NOTICE, ("mozilla public license v 2 0",)),
    ("epl-2", EPL_NOTICE, ("eclipse public license 2 0",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc0", "Dedicated to the public domain under CC0 1.0", ("cc0 1 0",)),
)
