"""Facts from C#, Java, TypeScript and JavaScript sources."""
