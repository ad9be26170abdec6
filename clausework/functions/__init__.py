"""Column expressions. All of them stay in the JVM except the page parser and the encoder."""
