"""A small repository in which every kind of edge occurs."""

FILES = {
    "package.json": '{"name": "shop", "version": "1.2.0", "type": "module", "main": "./src/index.ts", "bin": {"shop": "./src/cli.ts"}, "exports": {".": {"import": "./src/index.ts"}}, "dependencies": {"express": "1"}, "devDependencies": {"typescript": "5", "vitest": "1"}}',
    ".gitignore": "secret/\n*.log.ts\n!keep.log.ts\n",
    "secret/key.ts": "export const key = 1;\n",
    "debug.log.ts": "export const a = 1;\n",
    "keep.log.ts": "export const kept = 1;\n",
    "node_modules/x/index.ts": "export const x = 1;\n",
    "notes.md": "# not a source\n",
    "src/index.ts": 'export * from "./services/order.js";\nexport { TokenStore as Store } from "./store/token";\nexport { helper } from "./util";\n',
    "src/util.ts": "/** Helps with everything.\n * @returns one\n */\nexport function helper(n: number): number { return twice(n); }\nfunction twice(n: number) { return n * 2; }\nexport const onlyHere = () => helper(1);\n",
    "src/store/base.ts": "export interface Keeper { keep(x: string): void }\nexport abstract class BaseStore {\n  protected items = new Map<string, string>();\n  put(k: string) { this.items.set(k, k); }\n}\n",
    "src/store/token.ts": 'import { BaseStore, type Keeper } from "./base.js";\n/** Stores auth tokens. */\nexport class TokenStore extends BaseStore implements Keeper {\n  keep(x: string) { this.put(x); this.check(x); }\n  check(x: string): boolean { return x.length > 0; }\n}\n',
    "src/services/order.ts": 'import express from "express";\nimport { Store } from "../index.js";\nimport * as util from "../util";\nimport type { Keeper } from "../store/base";\nexport class OrderService {\n  constructor(private readonly store: Store) {}\n  place(k: Keeper): void { const t = new Store(); t.keep("a"); util.helper(2); uniqueThing(); }\n}\nexport const app = express();\n',
    "src/far.ts": "export function uniqueThing(): void {}\n",
    "src/cli.ts": 'import { OrderService } from "./index";\nconst service = new OrderService(null);\nservice.place();\n',
    "tests/order.test.ts": 'import { OrderService } from "../src/services/order";\nnew OrderService(null);\n',
}


def write(root) -> None:
    for path, text in FILES.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
