"""Column functions: URLs, HTML, records. Everything here stays inside the JVM."""
