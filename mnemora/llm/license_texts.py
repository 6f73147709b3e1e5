"""Labelled paragraphs for the licence classifier: notices per family, and prose that only sounds like one."""

#: What the licences themselves, and the notices they ask for, say (fixed values). Each is also a template to compare with.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The MIT License (MIT)",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "See the GNU General Public License for more details.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "You may redistribute it under the terms of the GNU Affero General Public License.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "public-domain": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited. All rights reserved.",
    ),
}

#: Paragraphs of the class "unknown": prose about licences, rights and projects, and licences of other families.
UNKNOWN: tuple[str, ...] = (
    "She lost her driving license on the way to the station.",
    "The fishing licence costs ten euros a year.",
    "A licensed electrician must inspect the wiring before release.",
    "The software license market grew by four percent last year.",
    "Our lawyers discussed which license would suit the project best.",
    "The new version of the license was published in June.",
    "He studied at MIT and later worked for a public radio station.",
    "The Apache helicopter landed near the village.",
    "The Apache people lived in the south-west.",
    "Mozilla announced a new browser for phones.",
    "The GNU project was started in 1983.",
    "The general public was not admitted to the hearing.",
    "Civil rights were reserved for a few citizens at that time.",
    "The rights of the tenant are protected by law.",
    "He asked for permission to leave the room.",
    "Copyright law differs from country to country.",
    "They argued about copyright for hours.",
    "The warranty covers parts and labour for two years.",
    "The copy of the license hangs on the wall of the shop.",
    "A creative mind finds common ground in unlikely places.",
    "The commons were grazed by sheep from the village.",
    "Attribution of the painting to the master is doubtful.",
    "The public domain of the town covers forty acres.",
    "The picture has been in the public domain since 1950, he said.",
    "The redistribution of land was the main issue of the election.",
    "BSD is an operating system family.",
    "Please send a cc to the whole team by noon.",
    "Version 2.0 of the form is available at the counter.",
    "The license plate was covered with mud.",
    "The pilot renewed the license after a medical check.",
    "You may not park here without a permit or license.",
    "The council granted a liquor license to the bar.",
    "Licensing fees are due at the end of the month.",
    "The license terms of the product are confusing for many users.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Licensed under the European Union Public Licence.",
    "Released under the Artistic License.",
    "Released under the zlib license.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "This font is licensed under the SIL Open Font License.",
    "Licensed under the Boost Software License, version 1.0.",
    "Released under the PHP license.",
    "Licensed under the terms of the agreement between the parties.",
    "Licensed to practise medicine in three states.",
    "Released under the supervision of the court.",
    "This work is licensed for use in schools.",
    "The library is released every spring under a new name.",
    "The free software foundation held a conference in the city.",
    "You should have received a copy of the invoice along with this letter.",
    "The terms of the loan are set out below.",
)

#: Sentences around a notice, for training and for calibration on forms not trained on.
TRAIN_FRAMES = (
    "{}", "Copyright (c) 2019 The Authors. {}", "{} See the file for details.", "About this project: {}", "{} Please read it before you go on.",
    "Written by the team in 2018. {} It was a long day for us.", "we went to the river with them and {} that is what he said about the day",
    "{} Thanks to all who wrote to us about this book for years.", "What is new? {} Questions and comments are welcome.",
)
HELD_OUT_FRAMES = ("* {}", "(c) 2021 by somebody else. {} Thank you for reading.", "Note. {} More text follows here, about the weather.")

#: Short names of each family as projects write them, and its SPDX identifiers.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT",),
    "apache": ("Apache", "Apache 2.0", "ASL 2.0"),
    "gpl": ("GPL", "GPLv3", "GNU GPL", "GNU GPL v2", "GNU General Public License"),
    "lgpl": ("LGPL", "LGPLv3", "GNU LGPL", "GNU Lesser General Public License", "GNU Library General Public License"),
    "agpl": ("AGPL", "AGPLv3", "GNU AGPL", "GNU Affero General Public License"),
    "bsd": ("BSD", "BSD 3-Clause", "3-Clause BSD", "New BSD", "Simplified BSD", "Modified BSD"),
    "mpl": ("MPL", "MPL 2.0", "Mozilla Public License", "Mozilla Public License 2.0"),
    "cc-by": ("CC BY", "CC BY 4.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0 International"),
    "cc-by-sa": ("CC BY-SA", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "cc-by-nc": (
        "CC BY-NC", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial",
        "Creative Commons Attribution-NonCommercial 4.0 International"
    ),
    "public-domain": ("CC0", "CC0 1.0", "Unlicense", "CC0 1.0 Universal"),
}
_GNU = ("{}", "{}+", "{}-only", "{}-or-later")
_gnu = lambda ids: tuple(f.format(x) for x in ids for f in _GNU)
_cc = lambda kind: tuple(f"CC-{kind}-{v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0"))
SPDX: dict[str, tuple[str, ...]] = {
    "mit": ("MIT", "MIT-0", "MIT-Modern-Variant", "MIT-open-group", "MIT-feh"),
    "apache": ("Apache-1.0", "Apache-1.1", "Apache-2.0"),
    "gpl": _gnu(("GPL-1.0", "GPL-2.0", "GPL-3.0")),
    "lgpl": _gnu(("LGPL-2.0", "LGPL-2.1", "LGPL-3.0")),
    "agpl": _gnu(("AGPL-1.0", "AGPL-3.0")),
    "bsd": (
        "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-2-Clause-Views", "BSD-3-Clause", "BSD-3-Clause-Attribution", "BSD-3-Clause-Clear",
        "BSD-3-Clause-LBNL", "BSD-4-Clause", "BSD-4-Clause-UC"
    ),
    "mpl": ("MPL-1.0", "MPL-1.1", "MPL-2.0", "MPL-2.0-no-copyleft-exception"),
    "cc-by": _cc("BY"),
    "cc-by-sa": _cc("BY-SA"),
    "cc-by-nc": (*_cc("BY-NC"), *_cc("BY-NC-SA"), *_cc("BY-NC-ND")),
    "public-domain": ("CC0-1.0", "Unlicense", "CC-PDDC"),
}

#: Headings of whole licence texts.
HEADINGS: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "The MIT License"),
    "apache": ("Apache License Version 2.0, January 2004", "Apache License"),
    "gpl": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "lgpl": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "agpl": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "The BSD License"),
    "mpl": ("Mozilla Public License Version 2.0",),
    "cc-by": ("Creative Commons Attribution 4.0 International Public License",),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "public-domain": ("CC0 1.0 Universal", "The Unlicense"),
}

#: What a short notice must hold in whole to be confirmed, and the sentences it is trained on.
KEYS = ("{} license", "license {}", "licensed under {}", "licensed under the {}", "released under {}")
SHORT_FORMS = (
    *KEYS, "This project is {} licensed, license {}.", "Licensed under the terms of the {} license.", "Released under the {} license.",
    "This work is licensed under the {} license.", "This project is licensed under the {} license, see the file.", "Distributed under the {} license.",
    "Copyright 2019 The Authors. Licensed under the {} license.", "You may use and change this software under the terms of the {} license.",
    "Available under {}.", "Code: {} license", "Copyright 2020 by us, {} license.", "(C) 2018 the project. {} license.", "All files here are covered by the {} license.",
    "The book is covered by the {} license.", "We publish this under the {} license.", "It was published under the {} license.", "(c) The Authors. {} license. Written for the people of the town.",
    "About the river and the town. Released under {}. It was a long day for us.",
    "the rain in the town was heavy licensed under {} and the people stayed in",
)
#: Further notices, to calibrate probabilities on; never trained on and no templates.
CALIBRATION_NOTICES = (
    "Published under the {} license.", "The sources are covered by the {} license.", "(C) 2022 the team, {} license.", "Terms of use: {} license"
)
#: Sentences about a licence that grant nothing: denials, citations, comparisons, questions. Those trained on, those to calibrate on, those to measure on.
DENIALS = (
    "This article is not licensed under the {} license.", "The text was never released under the {} license.", "It can no longer be used under the {} license.",
    "Do not use the {} license here.", "The author refused to license the work under {}.", "None of this is under the {} license.", "Nobody published it under the {} license.", "It was never covered by the {} license.",
    "We compared the {} license with other licenses.", "Unlike the {} license, ours asks for a fee.", "He wrote about the {} license in a paper.",
    "She explained the {} license to the class.", "They discussed whether the {} license would fit.", "A critique of the {} license and its terms was printed.",
    "The {} license is popular with companies.", "The history of the {} license is long.", "An introduction to the {} license for lawyers.",
    "The court interpreted the {} license last year.", "Nobody has read the {} license to the end.", "The {} license was rejected by the board.",
    "Is the {} license compatible with the older one?", "Projects under the {} license grew in number last year.", "I read the {} license on the train.",
    "Questions about the {} license go to the legal team.", "The license of the {} license test was a license.", "The {} license differs from a contract in many ways.",
    "We chose neither the {} license nor a contract.", "The {} license appears in a book about software.", "What does the {} license mean?",
)
CALIBRATION_DENIALS = (
    "This file is not covered by the {} license.", "The committee discussed the {} license for hours.", "A comparison of the {} license and its rivals follows.",
    "Critics of the {} license point to its length.", "The lecture explains the {} license and patents.", "Nobody wrote under the {} license.",
)
HELD_OUT_DENIALS = (
    "We compared the {} license with another license and chose neither.", "He wrote about the {} license in his thesis.", "This text is not available under the {} license.",
    "The {} license appears in many school books.", "What does the {} license say about patents?", "This was never under the {} license.",
)
#: Notices in words that no form above has, to measure recall on; never trained on and no templates.
HELD_OUT_NOTICES = (
    "The code is made available under a {} license.", "Project license: {}", "You can use this under the {} license or ask us.",
    "Everything here is licensed under {} unless noted.", "Code license - {}"
)

UNKNOWN_SHORT: tuple[str, ...] = (
    "All rights were reserved to the crown.", "All rights reserved to the lords by custom were lost.", "The rights reserved by the treaty of 1763 were few.",
    "All rights reserved for members of the guild, said the charter.", "All rights reserved by the duke in his will passed to the abbey.",
    "License: EPL-2.0", "License: Zlib", "License: ISC", "ISC License", "Eclipse Public License", "Artistic License", "Licensed under EUPL 1.2.", "Licensed under zlib.", "License: BSL-1.0", "Boost Software License 1.0", "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International License", "European Union Public License", "SIL Open Font License", "Driving license", "License: yes", "Public license", "General license",
    "License agreement", "License key: 2.0", "Licensed under contract.", "Licensed under the law of the state.", "GNU Free Documentation License", "SPDX-License-Identifier: GFDL-1.3-only", "Common Public License", "CDDL license", "Python license", "License: PSF-2.0", "Public domain of the town",
)
