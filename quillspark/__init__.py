"""PySpark-native analytics over large corpora of Markdown and plain-text documents."""
