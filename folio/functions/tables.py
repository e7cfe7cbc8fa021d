"""Lookup tables. All values in this module are fixed values: they must equal the published ones."""

from __future__ import annotations

# Directories of build output, installs, caches and vendored toolchains.
GENERATED_DIRS = """.angular .astro .bin .cache .dart_tool .docusaurus .eggs .figure-audit .git .gradle .hg .hypothesis .ipynb_checkpoints
.mypy_cache .next .nox .nuxt .open-next .output .parcel-cache .pnp .pytest_cache .ruff_cache .serverless .svelte-kit .svn .tox .turbo .venv
.vercel .vite .worktrees .wrangler .yarn CMakeFiles __pycache__ bower_components build coverage dist htmlcov node_modules out runs
site-packages storybook-static target toolchains vendor venv""".split()

# File globs left out by default.
DEFAULT_FILE_GLOBS = """*.min.js *.min.css *.tsbuildinfo next-env.d.ts *.egg-info/** *.dist-info/** package-lock.json yarn.lock pnpm-lock.yaml bun.lock
bun.lockb .env .env.* *.pem *.key id_rsa id_rsa.* *.pyc *.pyo *.class *.o *.a *.so *.dylib *.dll *.exe *.wasm *.bin .DS_Store Thumbs.db""".split()

# File names that are text whatever their extension.
TEXT_NAMES = """dockerfile makefile gnumakefile license licence copying authors contributors changelog readme cargo.lock gemfile rakefile procfile
justfile cmakelists.txt vagrantfile lakefile.lean lakefile.toml go.mod go.work""".split()

# Kinds that an extension names outright.
KIND_OF_EXTENSION = {
    "html": "html htm xhtml",
    "xml": "xml xsl xslt plist",
    "json": "json jsonc json5 jsonl ndjson geojson",
    "csv": "csv",
    "tsv": "tsv",
    "pdf": "pdf",
    "docx": "docx dotx",
    "pptx": "pptx potx",
    "sheet": "xlsx xlsm xls xltx ods",
    "odt": "odt",
    "odp": "odp",
    "epub": "epub",
    "rtf": "rtf",
    "ipynb": "ipynb",
    "npy": "npy",
    "npz": "npz",
    "zip": "zip zipx",
}

# Extensions of binary files.
BINARY_EXTENSIONS = """png jpg jpeg gif webp ico bmp tif tiff heic avif psd woff woff2 ttf otf eot mp3 mp4 m4a aac ogg flac wav avi mov mkv webm exe dll
so dylib o a lib class pyc pyo rlib rmeta wasm bin sqlite sqlite3 db parquet arrow feather pkl pickle joblib safetensors pt pth onnx gguf ggml
binpb icns dmg iso img pack idx pdb ilk obj fits fit fts ftz h5 hdf5 hdf nc mat sav gz bz2 xz zst lzma lz4 pkg mod smod""".split()

# Language of a file name.
LANGUAGE_OF_NAME = {
    "docker": "dockerfile containerfile",
    "make": "makefile gnumakefile",
    "just": "justfile",
    "cmake": "cmakelists.txt",
    "lean": "lakefile.lean",
    "toml": "lakefile.toml cargo.lock",
    "ruby": "gemfile rakefile vagrantfile podfile brewfile",
    "procfile": "procfile",
    "go": "go.mod go.sum go.work",
    "groovy": "build.gradle settings.gradle",
    "earthfile": "earthfile",
}

# Language of an extension, for kinds of text that the kind table does not name.
LANGUAGE_OF_TEXT_EXTENSION = {
    "lean": "lean", "rust": "rs", "python": "py pyi pyw", "javascript": "js mjs cjs", "typescript": "ts", "tsx": "tsx", "jsx": "jsx",
    "go": "go", "java": "java", "kotlin": "kt kts", "c": "c h hh hpp hxx", "cpp": "cpp cc cxx", "objc": "m", "objcpp": "mm", "csharp": "cs",
    "fsharp": "fs fsx fsi", "swift": "swift", "ruby": "rb rake gemspec podspec", "php": "php", "lua": "lua", "r": "r", "julia": "jl", "sql": "sql",
    "dart": "dart", "scala": "scala sc", "groovy": "groovy", "elixir": "ex exs", "heex": "heex", "erlang": "erl hrl", "haskell": "hs lhs",
    "ocaml": "ml mli", "nim": "nim", "zig": "zig", "v": "v", "d": "d", "pascal": "pas", "perl": "pl pm", "raku": "raku", "protobuf": "proto",
    "thrift": "thrift", "graphql": "graphql gql", "prisma": "prisma", "vue": "vue", "svelte": "svelte", "astro": "astro", "solidity": "sol",
    "move": "move", "wgsl": "wgsl", "glsl": "glsl", "hlsl": "hlsl", "metal": "metal", "asm": "asm s", "wat": "wat", "wit": "wit",
    "clojure": "clj cljs", "edn": "edn", "lisp": "lisp el", "vim": "vim", "nix": "nix", "hcl": "tf hcl", "cue": "cue", "jsonnet": "jsonnet",
    "starlark": "bzl bazel", "cabal": "cabal", "cmake": "cmake", "make": "make mk", "ninja": "ninja", "toml": "toml", "yaml": "yaml yml",
    "markdown": "md markdown mdx", "rst": "rst", "org": "org", "latex": "tex bib", "css": "css", "scss": "scss sass", "less": "less",
    "xml": "dtd xsd wsdl", "svg": "svg", "shell": "sh bash zsh fish command", "powershell": "ps1", "batch": "bat cmd", "diff": "diff patch",
    "lock": "lock", "sum": "sum", "dotnet": "csproj fsproj vbproj sln",
    "config": "gitignore gitattributes dockerignore editorconfig env properties ini cfg conf cnf tomlrc npmrc nvmrc prettierrc eslintrc babelrc zshrc bashrc profile gitconfig",
    "fortran": "f f77 f90 f95 f03 f08 for ftn fypp fpp fi", "uml": "puml plantuml", "graphviz": "dot gv", "ron": "ron", "kdl": "kdl", "hurl": "hurl",
    "http": "http rest", "template": "jinja j2 njk ejs erb twig liquid hbs mustache pug jade haml slim in", "razor": "cshtml razor", "jsp": "jsp jspx",
    "math": "math", "pgp": "asc pgp gpg", "rules": "rules", "data": "dat data", "cython": "pyx pxd pxi", "afm": "afm", "pkgconfig": "pc",
    "libtool": "la", "modulemap": "modulemap", "mplstyle": "mplstyle", "idl": "pro", "texinfo": "info",
}

# Further text extensions, which are their own label.
OTHER_TEXT_EXTENSIONS = """txt text log gradle sbt csvmd hsig hjson cson mjml adoc asciidoc textile wiki pod rdoc man mdoc header ipp tpp inl inc def asmx
aspx ascx master cfm cfc upl f18 f13""".split()

# Labels of extensions that name no kind of text.
LANGUAGE_OF_OTHER_EXTENSION = {
    "olean": "olean", "agda": "agda lagda", "idris": "idr lidr", "svg": "svgz",
    "html": "html htm xhtml", "xml": "xml xsl xslt plist", "json": "json jsonc json5 jsonl ndjson geojson", "csv": "csv", "tsv": "tsv",
    "ipynb": "ipynb", "pdf": "pdf", "docx": "docx dotx", "pptx": "pptx potx", "sheet": "xlsx xlsm xls xltx ods", "odt": "odt", "odp": "odp",
    "epub": "epub", "rtf": "rtf", "npy": "npy", "npz": "npz", "zip": "zip zipx", "tar": "tar",
    "image": "png jpg jpeg jpe gif webp ico bmp tif tiff heic heif avif psd ai eps icns", "font": "woff woff2 ttf otf eot",
    "audio": "mp3 m4a aac ogg flac wav", "video": "mp4 avi mov mkv webm", "purescript": "purs", "elm": "elm", "racket": "rkt", "scheme": "scm ss",
    "cobol": "cob cbl", "ada": "adb ads", "crystal": "cr", "nim": "nimble", "reason": "re rei", "rescript": "res resi", "ligo": "mligo jsligo",
    "wat": "wast", "sml": "sml fun sig", "opencl": "cl", "cuda": "cu cuh", "glsl": "comp frag vert", "fits": "fits fit fts ftz",
    "hdf5": "h5 hdf5 hdf", "netcdf": "nc", "matlab": "mat", "compressed": "gz bz2 xz zst lzma lz4", "package": "pkg dmg",
}

# Fence language of an extension in Markdown output.
FENCE_OF_EXTENSION = {
    "rust": "rs", "lean": "lean", "python": "py", "markdown": "md markdown", "typescript": "ts", "tsx": "tsx", "javascript": "js", "json": "json",
    "toml": "toml", "html": "html htm", "xml": "xml", "yaml": "yml yaml", "bash": "sh", "csv": "csv", "text": "npy npz",
}

# Files and extensions that start unticked.
LOCK_NAMES = ("go.sum", "npm-shrinkwrap.json", "shrinkwrap.yaml")
LOCK_ENDS = (".lock", ".lockb", "-lock.json", "-lock.yaml", "-lock.yml")
GENERATED_NAMES = ("next-env.d.ts", ".ds_store", "thumbs.db")
GENERATED_ENDS = (".tsbuildinfo", ".min.js", ".min.css")
IMAGE_EXTENSIONS = "svg svgz png jpg jpeg jpe gif webp ico icns bmp tif tiff heic heif avif psd ai eps".split()
PGP_EXTENSIONS = ("asc", "pgp", "gpg")
CYTHON_EXTENSIONS = ("pyx", "pxd", "pxi")
VENV_NAMES = (".venv", "venv")

# Kinds whose reader runs in a process of its own.
HEAVY_KINDS = ("pdf", "docx", "pptx", "sheet", "odt", "odp", "epub", "rtf")
ARCHIVE_KINDS = ("zip", "tar", "targz")


def spread(table: dict[str, str]) -> dict[str, str]:
    """{value: 'key key'} turned into {key: value}."""
    return {k: v for v, keys in table.items() for k in keys.split()}


def kind_of_extension() -> dict[str, str]:
    """Kind of every known extension: named kinds, binaries, and text for all that have a text language."""
    text = {*spread(LANGUAGE_OF_TEXT_EXTENSION), *OTHER_TEXT_EXTENSIONS}
    return {**dict.fromkeys(text, "text"), **dict.fromkeys(BINARY_EXTENSIONS, "binary"), **spread(KIND_OF_EXTENSION)}


def language_of_extension() -> dict[str, str]:
    return spread(LANGUAGE_OF_TEXT_EXTENSION) | spread(LANGUAGE_OF_OTHER_EXTENSION)
