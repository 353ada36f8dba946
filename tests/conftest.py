import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textquarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SAMPLE = {
    "main.py": "\ndef greet():\n    '''Say hello.'''\n    print('Hello, World!')\n\nclass Adder:\n"
    "    '''Adds.'''\n\n    def add(self, a, b):\n        return a + b\n\n    def sub(self, a, b):\n"
    "        return a - b\n\nif __name__ == '__main__':\n    greet()\n",
    "utils.py": "\ndef process(data):\n    result = []\n    for item in data:\n"
    "        result.append(item.strip())\n    return result\n\n\ndef validate(value):\n"
    "    if not value:\n        raise ValueError('empty')\n    return True\n",
    "lib/helper.py": "\ndef shout(text):\n    return text.upper()\n\nclass Log:\n    '''Log.'''\n\n"
    "    def __init__(self, name):\n        self.name = name\n\n    def log(self, message):\n"
    "        print(f'[{self.name}] {message}')\n",
}


@pytest.fixture
def sample(spark):
    rows = [(i, "demo", p, t) for i, (p, t) in enumerate(SAMPLE.items())]
    return spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")
