"""Licence phrases, sentences and paragraphs, as public licences and their usual notices word them."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A licence text; its key phrase must stand whole. Without one the whole text must."""

    label: str
    text: str
    key: str = ""


#: Phrases whose places are counted.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)

#: Sentences that name a licence.
SENTENCES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl-3", "gnu lesser general public license version 3", "lesser general public license version 3"),
    Template("agpl-3", "gnu affero general public license version 3", "affero general public license version 3"),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
)

#: Paragraphs of licences and notices.
PARAGRAPHS = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "permission is hereby granted free of charge",
    ),
    Template(
        "apache-2",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "required by applicable law or agreed to in writing software distributed under the license",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
        "permission to use copy modify and or distribute this software for any purpose",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
        "under the terms of the gnu general public license",
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
        "under the terms of the gnu lesser general public license",
    ),
    Template(
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "under the terms of the gnu affero general public license",
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
        "subject to the terms of the mozilla public license",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "free and unencumbered software released into the public domain",
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "alter it and redistribute it freely",
    ),
    Template(
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "to any person or organization obtaining a copy of the software",
    ),
)
