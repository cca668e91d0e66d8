"""Stand-ins for PDF programs: scripts handed to the shell, so that no file must be there and executable on the executors."""

#: Stands in for a PDF text program: prints the lines of its input that are marked for the mode asked for.
TEXT = (
    "sh",
    "-c",
    r"""case "$*" in
*-tsv*) exec awk 'sub(/^T:/, "")' ;;
*) exec awk 'sub(/^P:/, "") { if (n++) printf "\n"; printf "%s", $0 }' ;;
esac""",
    "text",
)
#: Stands in for a PDF information program: prints the page sizes marked in its input, up to the page asked for.
INFO = (
    "sh",
    "-c",
    r"""last=1000000
while [ $# -gt 0 ]; do
  case "$1" in -l) last=$2 ;; esac
  shift
done
exec awk -v last="$last" 'sub(/^I:/, "") && (!/^Page / || $2 + 0 <= last)'""",
    "info",
)
#: Stands in for a PDF rendering program: prints the head of a PNG image of the size asked for.
IMAGE = (
    "sh",
    "-c",
    r"""while [ $# -gt 0 ]; do
  case "$1" in -scale-to-x) w=$2 ;; -scale-to-y) h=$2 ;; esac
  shift
done
cat >/dev/null
big() {
  for shift in 24 16 8 0; do
    printf "\\$(printf %03o $(($1 >> shift & 255)))"
  done
}
printf '\211PNG\r\n\032\n\000\000\000\015IHDR'
big "$w"
big "$h"
""",
    "image",
)
