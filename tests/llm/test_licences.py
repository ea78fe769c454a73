"""Standard notices as they are printed: wrapped, and behind comment signs."""

import pytest
from runlens.llm import licences

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.'''
APACHE = ''' * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions.'''
GPL = '''# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY.'''
MPL = '''// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this file.'''
TWO = "Licensed under the Apache License, Version 2.0\nReleased under the MIT License\nmore words"


@pytest.mark.parametrize("text, want, left", [
    (MIT, "MIT", 0), (APACHE, "Apache-2.0", 0), (BSD, "BSD-2-Clause", 0), (GPL, "GPL-3.0-or-later", 0), (MPL, "MPL-2.0", 0), (TWO, "Apache-2.0,MIT", 0),
    ("Released under CC0", "CC0-1.0", 0), ("some words\nReleased under the MIT License.\nmore", "MIT", 0),
])
def test_wrapped(spark, text, want, left):
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.licences, got.n_left) == (want, left), got
