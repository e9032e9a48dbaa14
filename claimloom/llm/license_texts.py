"""Licence notices to look for: label, words, and the phrases without which a match is none.

Fixed values: the notices' own wording, as their stewards publish it (the part that every copy has).
"""

#: (label, notice, mandatory phrases); a label may have several notices.
NOTICES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "Licensed under the MIT license.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted", "deal in the software")),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ("apache license version 2",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", ("apache license", "in compliance with the license")),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
     "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice", ("source and binary forms", "list of conditions")),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name", "endorse or promote products")),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2 of the license")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2",)),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0.", ("boost software license version 1",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered software", "public domain")),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", ("waived all copyright", "neighboring rights")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("commons attribution 4",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("commons attribution noncommercial",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    ("cc-by", "Licensed under CC BY 4.0.", ("cc by 4",)),
]

#: Phrases that give a label wherever their words stand one after the other.
PHRASES: dict[str, str] = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
