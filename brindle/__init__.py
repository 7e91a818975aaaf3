"""brindle: PySpark-native moderation analytics over message tables and streams."""
