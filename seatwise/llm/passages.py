"""Public licence notices and longer passages of licence texts, as (SPDX id, text).

Apostrophes are typographic; the scan reads letters and digits only.
"""

PASSAGES = (
    ("MIT",
     'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
     'merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
     'furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included '
     'in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
     'IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN '
     'NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
     'CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause",
     'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
     'conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the '
     'following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
     'following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE '
     'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
     'WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR '
     'CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT '
     'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED '
     'AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY '
     'WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause",
     'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
     'conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the '
     'following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
     'following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the '
     'copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without '
     'specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
     'IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE '
     'ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, '
     'EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, '
     'DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, '
     'OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY '
     'OF SUCH DAMAGE.'),
    ("ISC",
     'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided '
     'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
     'DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT '
     'SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
     'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN '
     'CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib",
     "This software is provided ’as-is’, without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
     "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
     "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
     "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
     "altered from any source distribution."),
    ("BSL-1.0",
     'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying '
     'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
     'and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all '
     'subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this '
     'restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative '
     'works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated '
     'by a source language processor.'),
    ("Unlicense",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
     "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
     "any and all copyright interest in the software to the public domain."),
    ("Apache-2.0",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to '
     'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
     'KIND, either express or implied. See the License for the specific language governing permissions and limitations under the '
     'License.'),
    ("Apache-2.0",
     "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
     "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly "
     "perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0",
     "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and "
     "in Source or Object form, provided that You meet the following conditions: (a) You must give any other recipients of the Work or "
     "Derivative Works a copy of this License; and (b) You must cause any modified files to carry prominent notices stating that You "
     "changed the files; and (c) You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, "
     "trademark, and attribution notices from the Source form of the Work, excluding those notices that do not pertain to any part of "
     "the Derivative Works; and"),
    ("GPL-2.0-or-later",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is "
     "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-or-later",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
     "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("AGPL-3.0-or-later",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
     "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
     "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("LGPL-2.1-or-later",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
     "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This "
     "library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0-or-later",
     "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
     "as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library "
     "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
     "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("GPL-2.0",
     "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public "
     "License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its "
     "users. This General Public License applies to most of the Free Software Foundation’s software and to any other program whose "
     "authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License "
     "instead.) You can apply it to your programs, too."),
    ("GPL-3.0",
     "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By "
     "contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to "
     "make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for "
     "most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too."),
    ("LGPL-2.1",
     "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of "
     "the Free Software Foundation and other authors who decide to use it. You can use it too, but we suggest you first think carefully "
     "about whether this license or the ordinary General Public License is the better strategy to use in any particular case, based on "
     "the explanations below."),
    ("LGPL-3.0",
     "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public "
     "License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0",
     "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to "
     "ensure cooperation with the community in the case of network server software."),
    ("GFDL-1.3",
     'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, '
     'Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and '
     'no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".'),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
     "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1",
     'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except '
     'in compliance with the License. You may obtain a copy of the License at https://www.mozilla.org/MPL/ Software distributed under '
     'the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the '
     'specific language governing rights and limitations under the License.'),
    ("Artistic-1.0",
     "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder "
     "maintains some semblance of artistic control over the development of the package, while giving the users of the package the right "
     "to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications."),
    ("CC0-1.0",
     'To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, '
     'irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer’s Copyright and Related Rights and associated '
     'claims and causes of action, whether now known or unknown (including existing as well as future claims and causes of action), in '
     'the Work (i) in all territories worldwide, (ii) for the maximum duration provided by applicable law or treaty (including future '
     'time extensions), (iii) in any current or future medium and for any number of copies, and (iv) for any purpose whatsoever, '
     'including without limitation commercial, advertising or promotional purposes (the "Waiver").'),
    ("CC-BY-4.0",
     "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
     "http://creativecommons.org/licenses/by/4.0/"),
    ("CC-BY-SA-4.0",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, "
     "visit http://creativecommons.org/licenses/by-sa/4.0/"),
    ("CC-BY-ND-4.0",
     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this "
     "license, visit http://creativecommons.org/licenses/by-nd/4.0/"),
    ("CC-BY-NC-4.0",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this "
     "license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    ("CC-BY-NC-SA-4.0",
     "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy of "
     "this license, visit http://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("CC-BY-NC-ND-4.0",
     "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License. To view a copy "
     "of this license, visit http://creativecommons.org/licenses/by-nc-nd/4.0/"),
)
