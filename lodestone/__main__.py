"""``python -m lodestone FILE COLUMN...``: index a file and serve it."""

import sys

from pyspark.sql import SparkSession

from lodestone.api import SearchIndex, serve

if __name__ == "__main__":
    if len(sys.argv) < 3:
        sys.exit(__doc__)
    session = SparkSession.builder.appName("lodestone").getOrCreate()
    serve(SearchIndex.from_file(session, sys.argv[1], sys.argv[2:]).persist()).serve_forever()
