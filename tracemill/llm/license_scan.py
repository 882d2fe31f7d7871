"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line with a word in it and the lines that it is wrapped onto: a next line goes on if
the line before does not end a sentence and it does not itself begin with a capital letter and a small
one, or if the line before ends with a comma.  Where that finds nothing, lines are also tried with all
that follow up to the end of a sentence, as a name may stand first in a line.
Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased; a paragraph's
features are its distinct runs of one, two and three words that occur in training paragraphs.  A
multinomial logistic regression over these sparse features gives each family, and an unknown class, a
probability.  It is trained on fragments of the templates below with words lost and added; its unknown
class on the same words in other order, on other sentences about licences, on notices of licences of
no family, and on templates whose names are replaced.

The probabilities are calibrated on what training does not see: for that, a first model is trained
without a part of the sentences of each family, of the other sentences and of the foreign licences, and
the temperature is fitted on paragraphs made of these.  ``Model.error`` is the expected calibration
error there.  The model that scans is trained on all of them.

A prediction stands if its family is likelier than ``least`` and a template of the family confirms it:
``share`` of the weight of the pairs of words of the paragraph, or of one of its sentences, must be the
family's, or ``share`` of the pairs of a template's sentence of six pairs or more must be the paragraph's.
A pair weighs one by the number of families that have it, so that names count and common words do not.
A paragraph with a word that names a neighbouring licence (a lesser licence, a share-alike clause, one
that allows no derivatives) is not the family's.
All other paragraphs are unknown.

Nulls: a null text has no paragraphs.  Ties: of equally likely families the first as listed.  Very long
texts and paragraphs are whole.  Columns are selected by name and renamed, so extra ones may have any
name.  Repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .decontamination import item_words
from .shared import arrow_map, batch_of, table

#: Notices and sentences by family, as public licences word them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, "
        "publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object "
        "form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without "
        "modifications, and in Source or Object form, provided that You meet the following conditions:",
        "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the "
        "Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the "
        "content of the NOTICE file.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License version 2 or later",
        "Released under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to "
        "make sure it remains free software for all its users.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you "
        "conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating "
        "that this License and any non-permissive terms added in accord with section 7 apply to the code.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more "
        "details.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU "
        "General Public License, supplemented by the additional permissions listed below.",
        "Licensed under the GNU Lesser General Public License version 2.1 or later.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically "
        "designed to ensure cooperation with the community in the case of network server software.",
        "Licensed under the GNU Affero General Public License version 3 or later.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Released under the 3-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        'Covered Software is provided under this License on an "as is" basis, without warranty of any kind, either expressed, '
        "implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, "
        "merchantable, fit for a particular purpose or non-infringing.",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "You are free to share and adapt the material for any purpose, even commercially, under the terms of the Creative "
        "Commons Attribution License.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as "
        "the original.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "You may not use the material for commercial purposes.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under the CC0 1.0 Universal public domain dedication.",
        "This work is dedicated to the public domain under CC0 1.0.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or "
        "her rights to the work worldwide under copyright law.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain.",
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "For more information, please refer to <http://unlicense.org/>",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium is strictly prohibited.",
    ),
}
#: What families are called, alone and in notices; and what people say of a licence without granting it.
CALLED = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License Version 2.0, January 2004", "Apache-2.0 license"),
    "MIT": ("MIT License", "MIT licence", "The MIT License (MIT)", "Expat license"),
    "GPL": ("GNU General Public License", "GNU General Public License v3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License version 2", "GPLv3", "GPL-3.0-or-later"),
    "LGPL": ("GNU Lesser General Public License", "GNU Lesser General Public License v3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "LGPLv3"),
    "AGPL": ("GNU Affero General Public License", "GNU Affero General Public License v3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "AGPLv3"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD licence", "New BSD License", "BSD license"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License 4.0", "Creative Commons Attribution 3.0 Unported", "CC BY 4.0 licence"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License 3.0", "CC BY-SA 4.0 licence"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License 3.0", "CC BY-NC 4.0 licence"),
    "CC0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "Unlicense": ("The Unlicense",),
    "ISC": ("ISC License",),
}
NOTICES = (
    "{}", "Licensed under the {}.", "Text is available under the {}.", "The library is distributed under the {}, see COPYING.",
    "This paper is distributed under the terms of the {}.", "This program is free to use under the {}.",
)
MENTIONS = (
    "She studied the {} for an hour and had many questions.", "Many people know the {} and some do not like it.",
    "The lecture compares the {} with others.", "We talked about the {} at dinner.",
)
TEMPLATES = {n: (*t, *(form.format(x) for x in CALLED.get(n, ()) for form in NOTICES)) for n, t in TEMPLATES.items()}
#: Clauses of whole licences, by family, beside the notices.
BODIES = {
    "Apache-2.0": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
        "royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and "
        "otherwise transfer the Work.",
        "Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be "
        "under the terms and conditions of this License, without any additional terms or conditions.",
    ),
    "GPL": (
        "Each time you convey a covered work, the recipient automatically receives a license from the original licensors, to run, modify and "
        "propagate that work, subject to this License.",
        "THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN WRITING THE COPYRIGHT "
        'HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM "AS IS" WITHOUT WARRANTY OF ANY KIND.',
    ),
    "MPL-2.0": (
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent "
        "or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit "
        "its Contributions.",
    ),
}
TEMPLATES = {n: tuple({tuple(item_words(x)): x for x in reversed((*t, *BODIES.get(n, ())))}.values())[::-1] for n, t in TEMPLATES.items()}
#: Words that a paragraph of a family does not hold: they name a neighbour of it, or a licence of no family here.
_NOT_BY = ("noderivatives", "noderivs", "noderivative", "nd")
NEVER = {
    "CC-BY": ("sharealike", "sa", "noncommercial", "nc", *_NOT_BY), "CC-BY-SA": ("noncommercial", "nc", *_NOT_BY),
    "CC-BY-NC": ("sharealike", "sa", *_NOT_BY), "GPL": ("lesser", "affero", "lgpl", "agpl"), "LGPL": ("affero", "agpl"), "AGPL": ("lesser", "lgpl"),
}
#: Notices of licences of no family here: the unknown class must take them.
FOREIGN = (
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Licensed under the University of Illinois Open Source License.", "Distributed under the terms of the Python Software Foundation License.",
    "Licensed under the Eclipse Public License 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "Licensed under the European Union Public Licence version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "This is free software under the terms of the Artistic License 2.0.",
    "Released under the zlib license.",
    "This work is licensed under the Open Data Commons Open Database License.",
    "Licensed under the Academic Free License version 3.0.",
    "This software is released under the Microsoft Public License.",
    "Licensed under the Business Source License 1.1.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
)
#: Sentences that share words with licences and are none.
OTHERS = (
    "All rights of way are reserved for walkers by the council.",
    "The rooms were reserved by the zoo for all of the guests.",
    "All rights reserved by the owner of the farm.",
    "No part of the bridge may be used without permission of the guard.",
    "The software is provided by the school and any person may copy the lessons.",
    "You may obtain a copy of the map at the office of the park.",
    "She lost her driving license on the way to the office.",
    "The minister granted permission to open the new bridge to the public.",
    "Software licenses are a topic of the second chapter of this work.",
    "The general public was free to use the library without a fee.",
    "Permission denied: the file could not be opened with this version of the program.",
    "A copy of the report was distributed to any person who asked for it.",
    "The Apache helicopter flew over the source of the river.",
    "The MIT campus is open to the public from nine to five.",
    "Copyright law is described in the following part of the text.",
    "The foundation published the terms of the prize and the conditions of entry.",
    "The Mozilla browser was released in a new version under a different name.",
    "Creative people share their common work with attribution of the authors.",
    "Licensed under terms to be announced by the holder.",
    "The license of this file is unknown.",
    *(form.format(x) for names in CALLED.values() for x in names[:2] for form in MENTIONS),
)
FAMILIES = ("unknown", *TEMPLATES)
_MASK_BITS = 18


def _hash_grams(words: tk.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for size in (1, 2, 3):
        yield words.window(size)


def _pairs(value: np.ndarray) -> np.ndarray:
    """Distinct hashes of the pairs of neighbours among words."""
    return np.unique(tk.Words(None, None, value, np.array([0, len(value)]), None).window(2)[0])


class Templates:
    """Pairs of words of the families, with their weights."""

    def __init__(self) -> None:
        self.sentences = {
            n: [x for t in s if len(x := _pairs(tk.hash_words(item_words(t))))] for n, s in TEMPLATES.items()
        }
        own = {n: np.unique(np.concatenate(s)) for n, s in self.sentences.items()}
        self.pairs, many = np.unique(np.concatenate(list(own.values())), return_counts=True)
        self.weight = 1 / many
        self.has = {n: np.isin(self.pairs, x) for n, x in own.items()}
        self.never = {n: tk.hash_words([w.encode() for w in words]) for n, words in NEVER.items()}

    def part(self, family: str, pairs: np.ndarray) -> float:
        """The share of the weight of ``pairs`` that is the family's; a pair of no family weighs one."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[at] == pairs
        weight = np.where(known, self.weight[at], 1.0)
        return float(weight[known & self.has[family][at]].sum() / weight.sum()) if len(pairs) else 0.0

    def confirm(self, family: str, sentences: list[np.ndarray], share: float) -> bool:
        """Whether a paragraph, given as the hashes of its sentences' words, is the family's."""
        words = np.concatenate(sentences)
        if family in self.never and np.isin(words, self.never[family]).any():
            return False
        whole = _pairs(words)
        if any(self.part(family, x) >= share for x in (whole, *map(_pairs, sentences))):
            return True
        return any(np.isin(x, whole).sum() >= share * len(x) for x in self.sentences[family] if len(x) >= 6)


@dataclass
class Model:
    """Sorted feature hashes, their weights by family, and templates' pairs of words."""

    features: np.ndarray
    mask: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: Templates
    error: float = 0.0
    least: float = 0.5
    share: float = 0.6

    def found(self, words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (paragraph, feature) pairs of known features."""
        rows, numbers = [], []
        for value, at in _hash_grams(words):
            near = np.flatnonzero(self.mask[value >> tk.U(64 - _MASK_BITS)])
            place = np.minimum(np.searchsorted(self.features, value[near]), len(self.features) - 1)
            hit = self.features[place] == value[near]
            rows.append(np.searchsorted(words.rows, at[near][hit], "right") - 1)
            numbers.append(place[hit])
        both = np.unique(np.concatenate(rows) * len(self.features) + np.concatenate(numbers))
        return both // len(self.features), both % len(self.features)

    def probabilities(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        z = np.tile(self.bias, (rows, 1))
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(row, self.weight[feature, k], rows)
        return _softmax(z / self.temperature)

    def label(self, words: tk.Words, data: np.ndarray) -> list[tuple[int, str, float]]:
        """(paragraph, family, probability) of those that are not unknown; ``data`` holds the words' bytes."""
        row, feature = self.found(words)
        own = np.unique(row)  # a paragraph without a known feature has the bias of the unknown class
        p = self.probabilities(np.searchsorted(own, row), feature, len(own))
        out = []
        for i in np.flatnonzero((p[:, 1:].max(1, initial=0) > self.least)).tolist():
            best, r = int(p[i].argmax()), int(own[i])
            if best and self.templates.confirm(FAMILIES[best], _sentences(words, r, data), self.share):
                out.append((r, FAMILIES[best], float(p[i, best])))
        return out


def _sentences(words: tk.Words, row: int, data: np.ndarray) -> list[np.ndarray]:
    """Hashes of a paragraph's words by sentence: one ends at a stop with white space behind it."""
    a, b = int(words.rows[row]), int(words.rows[row + 1])
    cuts = []
    for i in range(a, b - 1):
        between = data[words.end[i] : words.start[i + 1]].tobytes()
        if any(x in b".!?" and between[j + 1 : j + 2].isspace() for j, x in enumerate(between)):
            cuts.append(i + 1 - a)
    return np.split(words.hash[a:b], cuts)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


#: Words that name a family; a template in which others stand for them is of no family.
NAMES = (
    b"apache", b"mit", b"gnu", b"general", b"lesser", b"affero", b"bsd", b"mozilla", b"mpl", b"creative", b"commons", b"cc", b"cc0", b"by",
    b"isc", b"gpl", b"attribution", b"sharealike", b"noncommercial", b"unlicense", b"free", b"proprietary",
)


def _fragments(rng: np.random.Generator, sentences: list[list[bytes]], each: int, plain: list[bytes]) -> list[list[bytes]]:
    """Sentences, and pieces of them with words lost and a notice's surroundings added."""
    out = []
    for _ in range(each if sentences else 0):
        s = sentences[rng.integers(len(sentences))]
        n = len(s) if rng.random() < 0.5 else int(rng.integers(min(len(s), max(2, len(s) * 2 // 3)), len(s) + 1))
        at = int(rng.integers(len(s) - n + 1))
        words = [w for w in s[at : at + n] if rng.random() > 0.05]
        for _ in range(int(rng.integers(4))):
            words.insert(0 if rng.random() < 0.5 else len(words), plain[rng.integers(len(plain))])
        if rng.random() < 0.2:  # a line of copyright before it
            words = [b"copyright", b"c", str(1980 + int(rng.integers(50))).encode(), plain[rng.integers(len(plain))], *words]
        out.append(words)
    return out


def _samples(seed: int, each: int, held_back: bool | None) -> list[tuple[int, list[bytes]]]:
    """(family, words) made of the sentences that are held back for calibration, of the others, or of all."""
    rng = np.random.default_rng(seed)
    take = lambda items: [x for i, x in enumerate(items) if held_back is None or (i % 3 == 2) == held_back]
    everything = sorted({w for s in TEMPLATES.values() for t in s for w in item_words(t)})
    plain = sorted({w for t in take(OTHERS) for w in item_words(t)} - set(NAMES))
    out, named = [], []
    for k, name in enumerate(TEMPLATES, 1):
        sentences = [item_words(t) for t in take(TEMPLATES[name])]
        out += [(k, s) for s in sentences] + [(k, s) for s in _fragments(rng, sentences, each, plain)]
        named += [s for s in sentences if len(s) < 25 and set(s) & set(NAMES)]
    foreign, others = ([item_words(t) for t in take(x)] for x in (FOREIGN, OTHERS))
    out += [(0, s) for s in foreign + others]
    out += [(0, s) for s in _fragments(rng, foreign, 2 * each, plain) + _fragments(rng, others, 2 * each, plain)]
    for s in _fragments(rng, named, 2 * each, plain):
        out.append((0, [plain[rng.integers(len(plain))] if w in NAMES else w for w in s]))
    for _ in range(4 * each):
        pool = everything if rng.random() < 0.5 else plain
        out.append((0, [pool[i] for i in rng.integers(len(pool), size=int(rng.integers(1, 25)))]))
    return [(k, s) for k, s in out if s]


def _of(paragraphs: list[list[bytes]]) -> tk.Words:
    flat = tk.hash_words([w for p in paragraphs for w in p])
    return tk.Words(None, None, flat, np.concatenate([[0], np.cumsum([len(p) for p in paragraphs])]), None)


def _fitted(sample: list[tuple[int, list[bytes]]], rounds: int, l2: float) -> Model:
    label = np.array([k for k, _ in sample])
    words = _of([p for _, p in sample])
    features = np.unique(np.concatenate([v for v, _ in _hash_grams(_of([p for k, p in sample if k]))]))
    foreign = np.concatenate([v for v, _ in _hash_grams(_of([item_words(t) for t in FOREIGN]))])
    features = np.unique(np.concatenate([features, foreign]))
    mask = np.zeros(1 << _MASK_BITS, bool)
    mask[features >> tk.U(64 - _MASK_BITS)] = True
    kinds = len(FAMILIES)
    model = Model(features, mask, np.zeros((len(features), kinds)), np.zeros(kinds), 1.0, Templates())
    row, feature = model.found(words)
    target = np.eye(kinds)[label]
    m, v = np.zeros((len(features) + 1, kinds)), np.zeros((len(features) + 1, kinds))
    for t in range(1, rounds + 1):
        e = (model.probabilities(row, feature, len(label)) - target) / len(label)
        g = np.stack([np.bincount(feature, e[row, k], len(features)) for k in range(kinds)], 1) + l2 * model.weight
        g = np.vstack([g, e.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        model.weight -= step[:-1]
        model.bias -= step[-1]
    return model


def calibration_error(p: np.ndarray, label: np.ndarray, bins: int = 10) -> float:
    """Expected calibration error: the mean gap of confidence and accuracy over bins of confidence."""
    sure, right = p.max(1), p.argmax(1) == label
    at = np.minimum((sure * bins).astype(int), bins - 1)
    return float(sum(abs(sure[at == b].sum() - right[at == b].sum()) for b in range(bins)) / len(label))


@cache
def trained(seed: int = 11, each: int = 100, rounds: int = 120, l2: float = 1e-4) -> Model:
    """The model; training takes some seconds on the driver and reads no corpus."""
    first = _fitted(_samples(seed, each, False), rounds, l2)
    sample = _samples(seed + 1, each, True)
    label = np.array([k for k, _ in sample])
    row, feature = first.found(_of([p for _, p in sample]))
    losses = []
    for temperature in np.geomspace(0.5, 8, 25):  # the one under which what was held back is likeliest
        first.temperature = float(temperature)
        p = first.probabilities(row, feature, len(label))
        losses.append((-np.log(np.maximum(p[np.arange(len(p)), label], 1e-12)).mean(), first.temperature))
    first.temperature = min(losses)[1]
    model = _fitted(_samples(seed, each, None), rounds, l2)
    model.temperature = first.temperature
    model.error = calibration_error(first.probabilities(row, feature, len(label)), label)
    return model


_STOP = tk._lut(b".!?:;")
#: What may stand behind a sentence's end or at a line's: white space, quotes, brackets, signs of comments.
_CLOSE = tk._lut(b" \t\n\v\f\r\"')]}*/#-")


def paragraphs(chunk: tk.Chunk, loose: bool = False) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words by paragraph, and each paragraph's document, first line and last line, both from 0.

    With ``loose``, any line goes on from one that does not end a sentence.
    """
    # a row of the chunk is a line here: cut at line feeds and at texts' ends
    cuts = np.flatnonzero(chunk.data == 10) + 1
    offsets = np.unique(np.concatenate([cuts, chunk.offsets]))
    lines = tk.Chunk(0, len(offsets) - 1, chunk.data, offsets)
    words = tk.words(lines, tk.PUNCT)
    doc = np.searchsorted(chunk.offsets, offsets[:-1], "right") - 1
    some = np.flatnonzero(words.count() > 0)
    if not len(some):
        none = np.zeros(0, np.int64)
        return tk.Words(words.start, words.end, words.hash, np.zeros(1, np.int64), words.lower), none, none, none
    solid = np.flatnonzero(~_CLOSE[chunk.data])
    last = solid[np.searchsorted(solid, offsets[some + 1]) - 1]
    at = words.start[words.rows[some]]
    first, second = chunk.data[at], chunk.data[np.minimum(at + 1, len(chunk.data) - 1)]
    capital = (first >= 0x41) & (first <= 0x5A) & (second >= 0x61) & (second <= 0x7A)
    before = chunk.data[last[:-1]]
    on = np.zeros(len(some), bool)  # goes on from the line before
    on[1:] = (some[1:] == some[:-1] + 1) & (doc[some[1:]] == doc[some[:-1]]) & ~_STOP[before] & (loose | ~capital[1:] | (before == 0x2C))
    begin = np.flatnonzero(~on)
    end = np.append(begin[1:], len(some)) - 1
    rows = np.append(words.rows[some[begin]], words.rows[some[end[-1]] + 1])
    first_line = np.searchsorted(doc, np.arange(chunk.rows))
    of = doc[some[begin]]
    return tk.Words(words.start, words.end, words.hash, rows, words.lower), of, some[begin] - first_line[of], some[end] - first_line[of]


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_licensed", pa.int64()), ("families", pa.string()),
    ("spans", pa.string()), ("score", pa.float64()),
])
_FOUND_SQL = "doc_id long, n_paragraphs long, n_licensed long, families string, spans string, score double"


def licences(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: paragraphs, those of a licence, the families, and ``family:first line:last line`` spans.

    Lines count from 0; neighbouring paragraphs of a family are one span; ``score`` is the largest probability.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in tk.chunks(batch.column(1)):
            own: list[list[tuple[int, int, str, float]]] = [[] for _ in range(chunk.rows)]
            for loose in (True, False):
                words, doc, first, last = paragraphs(chunk, loose)
                found = [(int(doc[r]), int(first[r]), int(last[r]), f, p) for r, f, p in held.value.label(words, chunk.data)]
                if loose:
                    wide = found
            for d, *rest in found:
                own[d].append(tuple(rest))
            for d, a, b, family, p in wide:  # where no paragraph of these lines was found by itself
                if not any(x <= b and y >= a for x, y, *_ in own[d]):
                    own[d].append((a, b, family, p))
            yield batch_of(
                _FOUND, batch.column(0).slice(chunk.first, chunk.rows), np.bincount(doc, minlength=chunk.rows),
                [len(x) for x in own], [",".join(sorted({f for *_, f, _ in x})) for x in own], [_spans(x) for x in own],
                [max((p for *_, p in x), default=0.0) for x in own],
            )

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, _FOUND_SQL)


def _spans(found: list[tuple[int, int, str, float]]) -> str:
    out: list[list] = []
    for first, last, family, _ in sorted(found):
        if out and out[-1][0] == family and out[-1][2] == first - 1:
            out[-1][2] = last
        else:
            out.append([family, first, last])
    return ",".join(f"{f}:{a}:{b}" for f, a, b in out)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
