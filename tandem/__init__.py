"""tandem: analytics for catalogues of serialized works published in two formats, on Spark."""
